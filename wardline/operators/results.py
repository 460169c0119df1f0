"""Governed result cache as tables: writes, lookups replayed over a log, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.tokens import cache_key
from wardline.operators.asof import asof_join
from wardline.operators.policy import latest_by
from wardline.operators.skew import find_hot, split_join

# Seconds a result may be kept, by rank; 0 is never stored.
TTL_SECONDS = (3600, 1800, 300, 60, 0)


def ttl_seconds(rank: Column) -> Column:
    """Lifetime by sensitivity rank; unknown ranks are never stored."""
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in TTL_SECONDS]), rank), F.lit(0))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_key", cache_key(
        F.col("policy_version"), F.col("user_id"), F.col("agent_id"), F.col("query")))


def cache_writes(writes: DataFrame) -> DataFrame:
    """Writes that may be stored, with key and expiry."""
    return (with_key(writes).withColumn("ttl", ttl_seconds(F.col("sensitivity_rank")))
            .where("ttl > 0")
            .withColumn("expires_at", F.col("ts") + F.make_dt_interval(secs=F.col("ttl"))))


def cache_contents(writes: DataFrame) -> DataFrame:
    """Stored entry per key: a later write replaces the one before it."""
    return latest_by(cache_writes(writes), ["cache_key"], ["ts", "write_id"])


def cache_lookups(reads: DataFrame, writes: DataFrame, invalidations: DataFrame | None = None,
                  **options: int) -> DataFrame:
    """Outcome `lookup` of each read, as if reads and writes had run in time order.

    Reads have read_id, ts, user_id, agent_id, query, policy_version and, optionally,
    live_version, the version to check against. `invalidations` has ts and either user_id
    or policy_version. A read that finds an entry of another version or identity evicts it,
    and so does one that cannot be opened: `readable` of a write, true where it is not given.
    """
    if "readable" not in writes.columns:
        writes = writes.withColumn("readable", F.lit(True))
    stored = cache_writes(writes).select(
        "cache_key", "write_id", "readable", F.col("ts").alias("stored_at"), "expires_at",
        F.col("policy_version").alias("stored_version"), F.col("user_id").alias("stored_user"),
        F.col("agent_id").alias("stored_agent"))
    keyed = with_key(reads)
    if "live_version" not in reads.columns:
        keyed = keyed.withColumn("live_version", F.lit(None).cast("string"))
    keyed = keyed.withColumn("live_version", F.coalesce("live_version", "policy_version"))
    names = ["cache_key", "user_id", "policy_version", "ts"]
    base = keyed.select(*names)
    found = asof_join(
        keyed, stored, ["cache_key"], ts="ts", change_ts="stored_at", seq="write_id",
        payload=["write_id", "stored_at", "expires_at", "stored_version", "stored_user",
                 "stored_agent", "readable"], spread=["read_id"], **options)
    found = found.withColumn("removed_at", F.lit(None).cast(reads.schema["ts"].dataType))
    if invalidations is not None:
        found = _last_removal(found, invalidations, "user_id", None, base, options)
        found = _last_removal(found, invalidations, "policy_version", 16, base, options)
    stale = F.col("stored_version") != F.col("live_version")
    foreign = ((F.col("stored_user") != F.col("user_id"))
               | (F.col("stored_agent") != F.col("agent_id")))
    found = found.withColumn("lookup", F.when(
        F.col("write_id").isNull() | F.coalesce(
            F.col("removed_at") >= F.col("stored_at"), F.lit(False)), "MISS_KEY")
        .when(F.col("ts") > F.col("expires_at"), "MISS_EXPIRED")
        .when(~F.coalesce("readable", F.lit(False)), "MISS_CORRUPT")
        .when(foreign, "MISS_IDENTITY").when(stale, "MISS_VERSION").otherwise("HIT"))
    # Reads that found no write get a value of their own, so that they are spread as well.
    found = found.withColumn("_entry", F.coalesce(
        F.col("write_id").cast("string"), F.concat(F.lit("read "), F.col("read_id"))))
    evicted = (found.where(F.col("lookup").isin("MISS_CORRUPT", "MISS_IDENTITY", "MISS_VERSION"))
               .groupBy("_entry").agg(F.min(F.struct("ts", "read_id")).alias("evicted_by")))
    # Reads of one entry share its key, so an entry can only be hot where its key is.
    hot = find_hot(base, ["cache_key"])
    hot_entries = None if hot is None else find_hot(found, ["_entry"])
    found = split_join(found, evicted, ["_entry"], ["read_id"], "left", hot_entries)
    gone = F.coalesce(F.col("evicted_by") < F.struct("ts", "read_id"), F.lit(False))
    return (found.withColumn("lookup", F.when(gone, "MISS_KEY").otherwise(F.col("lookup")))
            .select(*reads.columns, "cache_key", "lookup",
                    F.when(F.col("lookup") == "HIT", F.col("write_id")).alias("write_id")))


def _last_removal(found: DataFrame, invalidations: DataFrame, scope: str, prefix: int | None,
                  base: DataFrame, options: dict[str, int]) -> DataFrame:
    """Raise `removed_at` to the last invalidation of the user or version before the read."""
    key = F.col(scope) if prefix is None else F.substring(scope, 1, prefix)
    events = invalidations.where(F.col(scope).isNotNull()).select(
        key.alias("_scope"), F.col("ts").alias("invalidated_at"), F.lit(0).alias("_order"))
    joined = asof_join(found.withColumn("_scope", key), events, ["_scope"], ts="ts",
                       change_ts="invalidated_at", seq="_order", payload=["invalidated_at"],
                       spread=["read_id"], base=base.withColumn("_scope", key), **options)
    return (joined.withColumn("removed_at", F.greatest("removed_at", "invalidated_at"))
            .drop("_scope", "invalidated_at"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits and misses per hour and outcome."""
    return (lookups.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "lookup")
            .agg(F.count(F.lit(1)).alias("n_reads")))


def hit_rate(lookups: DataFrame) -> DataFrame:
    """Hits, misses and reads over the log."""
    hit = F.col("lookup") == "HIT"
    return lookups.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
                       F.count(F.lit(1)).alias("reads"))


def seal(rows: DataFrame, columns: list[str], key: Column, into: str = "payload") -> DataFrame:
    """Encrypt columns of a row into one binary payload.

    `key` is a binary column, such as one joined from a table of secrets, so that it is
    no literal of the plan.
    """
    return rows.withColumn(into, F.aes_encrypt(F.to_json(F.struct(*columns)), key)).drop(*columns)


def unseal(rows: DataFrame, schema: T.StructType, key: Column, payload: str = "payload",
           into: str = "data") -> DataFrame:
    """Decrypt payloads; one that is corrupt or under another key gives null."""
    text = F.try_aes_decrypt(F.col(payload), key).cast("string")
    return rows.withColumn(into, F.from_json(text, schema))

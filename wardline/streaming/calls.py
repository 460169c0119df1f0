"""Verification and single use of tokens over a live stream of tool calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.tokens import query_hash
from wardline.operators.ledger import PASSED, check_code, first_uses, with_revocations
from wardline.operators.skew import salted_join


def check_stream(calls: DataFrame, ledger: DataFrame, revocations: DataFrame, ttl_seconds: int,
                 lateness: str = "10 minutes", remember: str = "1 hour",
                 salts: int = 1, require_token: bool = True) -> DataFrame:
    """Every call of a stream with its verdict, checked against a stream of ledger rows.

    Both sides are watermarked. A call meets the ledger row of its token from shortly before
    the token is valid until `remember` after it has expired, and is named by what matched;
    calls without a match, which come out once no match can follow, are unknown. `revocations`
    is a static table; where it grows, use `check_streams` or `judge_batches`. `salts` spreads
    the calls of a token over groups, for tokens that are called very often; each ledger row
    is then kept once per group.
    """
    joined = _with_ledger(calls, ledger, ttl_seconds, lateness, remember, salts)
    first = revocations.groupBy("kind", "id").agg(F.min("ts").alias("at"))
    tokens = first.where("kind = 'token'").select(
        F.col("id").alias("token_id"), F.col("at").alias("token_revoked_at"),
        _every_salt(salts).alias("_salt"))
    sessions = first.where("kind = 'session'").select(
        F.col("id").alias("session_id"), F.col("at").alias("session_revoked_at"),
        _every_salt(salts).alias("_salt"))
    return (joined.join(tokens, ["token_id", "_salt"], "left")
            .join(sessions, ["session_id", "_salt"], "left")
            .select(*calls.columns, "expires_at", check_code(require_token).alias("check")))


def _with_ledger(calls: DataFrame, ledger: DataFrame, ttl_seconds: int, lateness: str,
                 remember: str, salts: int) -> DataFrame:
    """Calls of a stream with the ledger row of their token, if one comes in time."""
    left = (calls.withWatermark("ts", lateness)
            .withColumn("call_hash", query_hash(F.col("query"))).withColumn("_salt", _salt(salts)))
    right = ledger.withWatermark("issued_at", lateness).select(
        F.col("token_id").alias("ledger_token"), F.col("agent_id").alias("token_agent_id"),
        "query_hash", "session_id", "issued_at", "expires_at",
        _every_salt(salts).alias("ledger_salt"))
    lifetime = F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    return left.join(right, (F.col("token_id") == F.col("ledger_token"))
                     & (F.col("_salt") == F.col("ledger_salt"))
                     & (F.col("ts") >= F.col("issued_at") - F.expr(f"INTERVAL {lateness}"))
                     & (F.col("ts") <= F.col("issued_at") + lifetime
                        + F.expr(f"INTERVAL {remember}")), "leftOuter")


def _untimed(ts: str) -> Column:
    """A time that no operator further on takes for the time of its rows."""
    return F.timestamp_micros(F.unix_micros(F.col(ts))).alias(ts)


def check_streams(calls: DataFrame, ledger: DataFrame, revocations: DataFrame, ttl_seconds: int,
                  lateness: str = "10 minutes", remember: str = "1 hour",
                  session_life: str = "31 days", salts: int = 1,
                  require_token: bool = True, every: str | None = None) -> DataFrame:
    """`check_stream` against revocations that are a third stream.

    All three are watermarked, and the watermark that counts is the slowest one, so calls wait
    for the revocations before them however early or late these come, within the `lateness`
    of their own stream. A revocation is remembered for `session_life`, which must be as long
    as a session lives. Each call comes out once and, over batches, in the order of time, so that
    `judge_batches` can label replays. Calls need a `ts`, and `call_id` must be unique.

    Calls are held until no ledger row or revocation that is still remembered can be older, so
    `remember` and `session_life` set how much of the log is state; `name_late` names calls that
    come after their token was forgotten. With `every`, only the first revocation of an id in each
    span of that length meets the calls, which then wait as long: a call never meets
    more revocations than there are spans, however often its session was revoked.
    """
    known = _with_ledger(calls, ledger, ttl_seconds, lateness, remember, salts).select(
        *calls.columns, "call_hash", "query_hash", "token_agent_id", _untimed("issued_at"),
        _untimed("expires_at"), "_salt", F.explode(F.array(
            F.struct(F.lit("token").alias("kind"), F.col("token_id").alias("id")),
            F.struct(F.lit("session").alias("kind"), F.col("session_id").alias("id"))
        )).alias("_by"))
    timed = revocations.withWatermark("ts", lateness)
    in_time = ((F.col("revoked_at") <= F.col("ts"))
               & (F.col("revoked_at") >= F.col("ts") - F.expr(f"INTERVAL {session_life}")))
    if every is not None:
        timed = (timed.groupBy("kind", "id", F.window("ts", every).alias("_span"))
                 .agg(F.min(F.unix_micros("ts")).alias("_first"))
                 .select("kind", "id", F.timestamp_micros("_first").alias("ts"),
                         F.window_time("_span").alias("r_time")))
        # Follows from the rest, and tells how long rows of either side are needed.
        in_time &= ((F.col("r_time") <= F.col("ts") + F.expr(f"INTERVAL {every}"))
                    & (F.col("r_time") >= F.col("ts") - F.expr(f"INTERVAL {session_life}")))
    revoked = timed.select(
        F.col("kind").alias("r_kind"), F.col("id").alias("r_id"), F.col("ts").alias("revoked_at"),
        *(["r_time"] if every is not None else []), _every_salt(salts).alias("r_salt"))
    met = known.join(
        revoked, (F.col("_by.kind") == F.col("r_kind")) & (F.col("_by.id") == F.col("r_id"))
        & (F.col("_salt") == F.col("r_salt")) & in_time, "leftOuter")
    carried = [c for c in met.columns if c not in (
        "ts", "call_id", "_by", "_salt", "r_kind", "r_id", "r_salt", "revoked_at", "r_time")]

    def first_of(kind: str) -> Column:
        return F.min(F.when(F.col("_by.kind") == kind, F.unix_micros("revoked_at")))

    once = met.groupBy("ts", "call_id").agg(
        F.first(F.struct(*carried)).alias("_row"),
        F.timestamp_micros(first_of("token")).alias("token_revoked_at"),
        F.timestamp_micros(first_of("session")).alias("session_revoked_at"))
    return once.select("ts", "call_id", "_row.*", "token_revoked_at", "session_revoked_at").select(
        *calls.columns, "expires_at", check_code(require_token).alias("check"))


def name_late(checked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Checked calls with those named whose token a stream no longer or not yet remembered.

    `ledger` is the table of all ledger rows so far. Only unknown calls meet it, and what it tells
    of them needs no revocation: their token has expired or is not valid yet.
    """
    late = (checked.where((F.col("check") == "TOKEN_UNKNOWN") & (F.col("token_id") != ""))
            .select("call_id", "token_id", "ts"))
    side = ledger.select("token_id", F.col("issued_at").alias("_from"),
                         F.col("expires_at").alias("_until"))
    named = salted_join(late, side, ["token_id"], ["call_id"], "inner", base=late).select(
        "call_id", F.when(F.col("ts") >= F.col("_until"), "TOKEN_EXPIRED")
        .when(F.col("ts") < F.col("_from"), "TOKEN_NOT_YET_VALID").alias("_late"))
    return checked.join(named, "call_id", "left").withColumn(
        "check", F.coalesce("_late", "check")).select(*checked.columns)


def keep_first(checked: DataFrame, salts: int = 8) -> DataFrame:
    """One passing call per token of a stream with a watermark on `ts`.

    Later calls on the token are dropped. Of several calls in the micro-batch that uses the
    token up, any may be kept; where the earliest must win, use `judge_batches`. The
    lateness of the watermark is how long a token is remembered, so it must be no shorter
    than the lifetime of a token. Calls are reduced to one per token and group before the
    calls of a token meet, so a token called very often fills no one task.
    """
    passed = checked.where(F.col("check") == PASSED).withColumn("_salt", _salt(salts))
    return (passed.dropDuplicatesWithinWatermark(["token_id", "_salt"]).drop("_salt")
            .dropDuplicatesWithinWatermark(["token_id"]))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("call_id"), F.lit(salts)).cast("int")


def _every_salt(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


#: Parts of the memory of used tokens per expiry date; a batch reads those its tokens fall into.
BUCKETS = 16


def judge_batches(used_path: str, out_path: str,
                  check: Callable[[DataFrame], DataFrame] | None = None
                  ) -> Callable[[DataFrame, int], None]:
    """Function for `foreachBatch` that labels every call, replays included.

    Each micro-batch is reduced to its first passing call per token before it meets the
    table of used tokens, so a token called very often is no burden to one task. Output
    and used tokens are written per batch and overwritten when a batch runs again. Used
    tokens are laid out by expiry date and a hash of the token. They are read no further back
    than the batch's first call, so that dates that are over are never listed and can be
    dropped, and only in the buckets that tokens used in this batch fall into.
    `check` turns calls into checked calls with the ledger and revocations of the moment.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = check(batch) if check is not None else batch
        if "expires_at" not in checked.columns:
            raise ValueError("checked calls need expires_at")
        expiry = checked.select("call_id", F.to_date("expires_at").alias("expires_on"))
        first = first_uses(checked).join(expiry, "call_id").select(
            "token_id", "call_id", "expires_on")
        bucket = F.pmod(F.xxhash64("token_id"), F.lit(BUCKETS)).cast("int")
        used = spark.read.schema("token_id string, expires_on date, bucket int, batch long"
                                 ).parquet(used_path)
        oldest = batch.select(F.to_date(F.min("ts")).alias("day")).first()["day"]
        # At most BUCKETS numbers.
        buckets = [r["bucket"] for r in first.select(bucket.alias("bucket")).distinct().collect()]
        earlier = used.where((F.col("batch") < batch_id) & (F.col("expires_on") >= F.lit(oldest))
                             & F.col("bucket").isin(buckets))
        fresh = first.join(earlier, "token_id", "left_anti")
        mark = fresh.select("call_id", F.lit(True).alias("_fresh"))
        judged = checked.join(mark, "call_id", "left").withColumn("verdict", F.when(
            (F.col("check") == PASSED) & F.col("_fresh").isNull(), "REPLAYED"
        ).otherwise(F.col("check"))).drop("_fresh", "check")
        # The used tokens of this batch go first: a rerun ignores and overwrites them.
        # One file per date and bucket, written side by side.
        for rows, path, parts in (
                (fresh.select("token_id", "expires_on", bucket.alias("bucket"),
                              F.lit(batch_id).cast("long").alias("batch"))
                 .repartition("expires_on", "bucket"), used_path,
                 ["expires_on", "bucket", "batch"]),
                (judged.withColumn("batch", F.lit(batch_id).cast("long")), out_path, ["batch"])):
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*parts).parquet(path))

    return run


def check_with(ledger: Callable[[SparkSession], DataFrame],
               revocations: Callable[[SparkSession], DataFrame],
               require_token: bool = True) -> Callable[[DataFrame], DataFrame]:
    """`check` for `judge_batches` that rereads ledger and revocations for each batch.

    Both are functions that read the table: a frame made once keeps the files it saw then, and
    would let through what was revoked after.
    """
    def check(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        side = with_revocations(ledger(spark), revocations(spark)).select(
            "token_id", "query_hash", F.col("agent_id").alias("token_agent_id"), "issued_at",
            "expires_at", "token_revoked_at", "session_revoked_at")
        joined = salted_join(batch.withColumn("call_hash", query_hash(F.col("query"))), side,
                             ["token_id"], ["call_id"], base=batch)
        return joined.select(*batch.columns, "expires_at",
                             check_code(require_token).alias("check"))

    return check


def time_cuts(table: DataFrame, ts: str, parts: int) -> list[int]:
    """Times in microseconds that cut a table into about equal parts."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    if parts == 1:
        return []
    return sorted(set(table.select(at.alias("at")).approxQuantile(
        "at", [n / parts for n in range(1, parts)], 0.01 / parts)))


def time_slices(table: DataFrame, ts: str, cuts: list[int]) -> list[DataFrame]:
    """The rows of a table between cuts, one table after the other in time, unknown times first."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    parts, low = [], None
    for high in [*cuts, None]:
        after = F.lit(True) if low is None else at > low
        until = F.lit(True) if high is None else F.coalesce(at <= high, F.lit(low is None))
        parts.append(table.where(after & until))
        low = high
    return parts


def append_in_order(table: DataFrame, path: str, ts: str, files: int) -> None:
    """Append a table to a folder as files that follow one another in time, unknown times first."""
    for part in time_slices(table, ts, time_cuts(table, ts, files)):
        part.coalesce(1).sortWithinPartitions(ts).write.mode("append").parquet(path)


#: Rows of a log that one batch of a stream over it brings into state, and those per state store.
SLICE_ROWS, STORE_ROWS = 3_000_000, 100_000


def run_in_slices(path: str, logs: dict[str, tuple[str, DataFrame]],
                  start: Callable[[dict[str, DataFrame]], StreamingQuery], first: str,
                  end: Column | None = None, slices: int = 4, slice_rows: int = SLICE_ROWS) -> None:
    """Append logs to folders slice by slice, and run a stream over them that stops in between.

    `logs` gives time column and stored table by name; the times of the log `first` cut all of
    them. A slice has as many files as tasks that write it, and is one batch as a whole: a run takes
    all that is there and ends, and the next one goes on from the checkpoint. `start` makes
    the running query from the streams. A row at `end`, if given, closes the logs, and only the
    last run has a batch without rows. Slices grow in number with the log, so that none outgrows memory.
    """
    spark = logs[first][1].sparkSession
    rows = logs[first][1].count()
    cuts = time_cuts(logs[first][1], logs[first][0], max(slices, -(-rows // slice_rows)))
    parts = {name: time_slices(log, ts, cuts) for name, (ts, log) in logs.items()}
    # State is dealt by hash to a number of stores that stays; each costs files in every batch.
    stores = max(spark.sparkContext.defaultParallelism, -(-min(rows, slice_rows) // STORE_ROWS))
    flush = "spark.sql.streaming.noDataMicroBatches.enabled"
    deal = "spark.sql.shuffle.partitions"
    before = {key: spark.conf.get(key) for key in (flush, deal)}
    for n in range(len(cuts) + 1):
        last = n == len(cuts)
        streams = {}
        for name, (ts, log) in logs.items():
            parts[name][n].write.mode("append").parquet(f"{path}/{name}")
            if last and end is not None:
                close_log(f"{path}/{name}", log, ts, end)
            streams[name] = spark.readStream.schema(log.schema).parquet(f"{path}/{name}")
        try:
            spark.conf.set(flush, str(last).lower())
            spark.conf.set(deal, str(stores))
            start(streams).awaitTermination()
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)


def close_log(path: str, table: DataFrame, ts: str, at: Column) -> None:
    """Append a row without content from after all others, which lets the watermark pass them.

    Its strings are empty and not null, since joins drop null keys before they see the time.
    """
    def filler(f: T.StructField) -> Column:
        if f.name == ts:
            return at
        return F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)

    last = [filler(f).alias(f.name) for f in table.schema.fields]
    table.sparkSession.range(1).select(*last).coalesce(1).write.mode("append").parquet(path)

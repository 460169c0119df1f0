"""As-of join: the last change at or before each row, per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.skew import (
    MIN_ROWS, PARTS, add_salt, count_rows, hot_keys, repeat_per_salt)


def asof_join(facts: DataFrame, changes: DataFrame, keys: Sequence[str], *, ts: str,
              change_ts: str, seq: str, payload: Sequence[str], spread: Sequence[str],
              base: DataFrame | None = None, bucket_seconds: int = 60, parts: int = PARTS,
              min_rows: int = MIN_ROWS) -> DataFrame:
    """Add to each fact the payload of the last change on its key with change time <= fact time.

    Changes at the same time are ordered by `seq`. Facts without one get nulls. There is
    no range join: facts and changes of a key are read in time order, after one shuffle.
    Only a hot key is cut into time buckets, each of which opens with the state that the
    buckets before it left behind; facts of a bucket that is still too large are spread by
    hash, with the changes of that bucket repeated. `base` is a table with the keys and
    times of all facts, by default `facts` itself; it is read to count rows per key, so name
    a stored table where `facts` is costly.
    """
    columns = facts.columns
    base = facts if base is None else base
    if not keys:
        facts, changes, base = (d.withColumn("_all", F.lit(0)) for d in (facts, changes, base))
    keys = list(keys) or ["_all"]
    group = [*keys, "_bucket"]
    bucket = F.lit(0).cast("long").alias("_bucket")
    known = [F.col(c).isNotNull() for c in [*keys, change_ts]]
    # Facts without a key match nothing; they are spread, so that they fill no one task.
    keyless = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    spread_out = F.when(keyless, F.pmod(F.xxhash64(*spread), F.lit(parts))).otherwise(F.lit(0))
    fact_rows = facts.select("*", spread_out.cast("long").alias("_bucket"),
                             F.col(ts).alias("_ts"), F.lit(True).alias("_is_fact"))
    change_rows = changes.where(reduce(lambda a, b: a & b, known)).select(
        *keys, bucket, F.col(change_ts).alias("_ts"), F.col(seq).alias("_seq"),
        F.struct(*payload).alias("_state"), F.lit(False).alias("_is_fact"))
    reads = base.select(*keys, bucket, F.col(ts).alias("_ts"))

    hot = hot_keys(count_rows(reads.select(*keys).unionByName(change_rows.select(*keys)), keys),
                   keys, parts, min_rows)
    if hot is None:
        both, within = fact_rows.unionByName(change_rows, allowMissingColumns=True), group
    else:
        both, within = _cut_hot_keys(
            fact_rows, change_rows, reads, hot, keys, spread, bucket_seconds, parts, min_rows)
    so_far = (Window.partitionBy(*within)
              .orderBy(F.col("_ts").asc_nulls_first(), "_is_fact",
                       F.col("_seq").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.withColumn("_found", F.last("_state", ignorenulls=True).over(so_far))
            .where("_is_fact")
            .select(*columns, *[F.col("_found")[c].alias(c) for c in payload]))


def _cut_hot_keys(fact_rows: DataFrame, change_rows: DataFrame, reads: DataFrame,
                  hot: DataFrame, keys: Sequence[str], spread: Sequence[str], width: int,
                  parts: int, min_rows: int) -> tuple[DataFrame, list[str]]:
    """Facts and states of the buckets of hot keys, and the columns that tell groups apart."""
    group = [*keys, "_bucket"]
    fact_rows, change_rows, reads = (
        _put_in_bucket(d, hot, keys, width) for d in (fact_rows, change_rows, reads))
    counts = count_rows(reads, group)
    cut = F.col("_bucket") != 0
    closing = (change_rows.where(cut).groupBy(*group)
               .agg(F.max_by("_state", F.struct("_ts", "_seq")).alias("_closing")))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    opening = (counts.where(cut).unionByName(closing, allowMissingColumns=True)
               .groupBy(*group).agg(F.max("_n").alias("_n"),
                                    F.first("_closing", ignorenulls=True).alias("_closing"))
               .withColumn("_state", F.last("_closing", ignorenulls=True).over(earlier))
               .where(F.col("_n").isNotNull() & F.col("_state").isNotNull())
               .select(*group, "_state", F.lit(False).alias("_is_fact")))
    states = change_rows.unionByName(opening, allowMissingColumns=True)
    crowded = hot_keys(counts, group, parts, min_rows)
    if crowded is None:
        return fact_rows.unionByName(states, allowMissingColumns=True), group
    salted = add_salt(fact_rows, crowded, group, spread, parts)
    return (salted.unionByName(repeat_per_salt(states, crowded, group), allowMissingColumns=True),
            [*group, "_salt"])


def _put_in_bucket(rows: DataFrame, hot: DataFrame, keys: Sequence[str],
                   width: int) -> DataFrame:
    """Give rows of hot keys the number of their time bucket, from 1 up."""
    second = F.unix_seconds(F.col("_ts").cast("timestamp"))
    number = F.floor(second / F.lit(width))
    numbered = F.when(number >= 0, number + 1).otherwise(number)
    return (rows.join(F.broadcast(hot), list(keys), "left")
            .withColumn("_bucket", F.when(F.col("_salts").isNull(), F.col("_bucket"))
                        .otherwise(numbered)).drop("_salts"))

"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/PARTS of the rows and more than MIN_ROWS rows.
# So fewer than PARTS keys are hot, which bounds what is collected and broadcast, and all
# salts together number fewer than 2 * PARTS.
PARTS = 1000
MIN_ROWS = 100_000


def hot_keys(counts: DataFrame, keys: Sequence[str], parts: int = PARTS,
             min_rows: int = MIN_ROWS) -> DataFrame | None:
    """Hot keys of a table of row counts `_n` per key, or None when no key is hot.

    `_salts` is the number of groups to split each key into. Counting is a job of its own,
    combined map-side, so that the plan of a join without hot keys stays a plain one.
    """
    size = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    share = max((size["total"] or 0) / parts, min_rows)
    if (size["largest"] or 0) <= share:
        return None
    hot = counts.where(F.col("_n") > share).select(
        *keys, F.ceil(F.col("_n") / F.lit(float(share))).cast("int").alias("_salts"))
    return counts.sparkSession.createDataFrame(hot.collect(), hot.schema)


def count_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, for rows that have one."""
    return rows.where(_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def add_salt(rows: DataFrame, hot: DataFrame, keys: Sequence[str], spread: Sequence[str],
             parts: int = PARTS) -> DataFrame:
    """Add `_salt`: spread rows of hot keys, and rows without a key, by their own hash."""
    row_hash = F.xxhash64(*spread)
    salt = F.when(~_present(keys), F.pmod(row_hash, F.lit(parts))).when(
        F.col("_salts").isNotNull(), F.pmod(row_hash, F.col("_salts"))).otherwise(F.lit(0))
    return (rows.join(F.broadcast(hot), list(keys), "left")
            .withColumn("_salt", salt.cast("int")).drop("_salts"))


def repeat_per_salt(side: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the rows of hot keys once per salt."""
    return (side.join(F.broadcast(hot), list(keys), "left")
            .withColumn("_salt", F.explode(F.sequence(
                F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
            .drop("_salts"))


def joins_are_split(base: DataFrame) -> bool:
    """Whether Spark splits skewed joins while it runs, from the sizes it sees."""
    conf = base.sparkSession.conf
    return all(conf.get(f"spark.sql.adaptive.{name}", "true").lower() == "true"
               for name in ("enabled", "skewJoin.enabled"))


def find_hot(base: DataFrame, keys: Sequence[str], parts: int = PARTS,
             min_rows: int | None = None) -> DataFrame | None:
    """Hot keys of a table, where rows without a key count as one: they too need spreading.

    Counting is a job over the keys before the query starts. Without `min_rows` it is left out
    where adaptive execution splits skewed joins, which sees sizes for nothing.
    """
    if min_rows is None:
        if joins_are_split(base):
            return None
        min_rows = MIN_ROWS
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return hot_keys(counts, keys, parts, min_rows)


def salted_join(facts: DataFrame, side: DataFrame, keys: Sequence[str], spread: Sequence[str],
                how: str = "left", base: DataFrame | None = None, parts: int = PARTS,
                min_rows: int | None = None) -> DataFrame:
    """Equi-join of a large table to a keyed one, split where a key is hot.

    Adaptive execution does the splitting where it is on; what follows is for sessions
    without it, and for a threshold given as `min_rows`. `spread` names columns of `facts` that tell its rows apart. Rows of a hot key are
    hashed by them into groups of about 1/`parts` of the table, and the matching rows of
    `side` are repeated per group. The result is that of a plain join on `keys`. Keys are
    counted in `base`, by default `facts`: name the stored table that `facts` was made of,
    so that counting reads one column of it and runs no joins twice. Counts only decide
    how rows are spread, so they need not be exact.
    """
    hot = find_hot(facts if base is None else base, keys, parts, min_rows)
    return split_join(facts, side, keys, spread, how, hot, parts)


def split_join(facts: DataFrame, side: DataFrame, keys: Sequence[str], spread: Sequence[str],
               how: str, hot: DataFrame | None, parts: int = PARTS) -> DataFrame:
    """`salted_join` for hot keys that are known, or None for a plain join."""
    keys = list(keys)
    if hot is None:
        return facts.join(side, keys, how)
    left = add_salt(facts, hot, keys, spread, parts)
    right = repeat_per_salt(side, hot, keys)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _present(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

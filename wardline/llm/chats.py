"""Chat formatting, in native expressions: logged snapshots collapse before rendering.

A log that writes a conversation after each turn holds many that are the beginning of a longer
one. Every turn gets a rolling hash of all turns so far: the sum of hashes of place, role and
text, which runs over buckets of turns, so that one long conversation is many small
windows. A conversation whose last hash is the hash of a place inside another one is a prefix
of it and leaves by an anti-join; of equal conversations the one with the smallest id stays. What is
left is rendered turn by turn and put together in segments of a fixed number of turns.

Defined results. Null roles and texts are empty; a null id is a conversation of its own; turns are
ordered by number (null first), role and text, and a turn logged twice counts once. Long texts
stay whole. Further columns are not carried. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import fits, read, stored

SEGMENT = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
HASHES = ("s1", "s2")


def running(df: DataFrame, bucket: str, order: list, values: dict) -> DataFrame:
    """Running sums over the rows of a conversation, first by bucket and then over buckets."""
    own = Window.partitionBy("conv", bucket).orderBy(*order)
    local = df.withColumns({k: F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, 0))
                            for k, v in values.items()})
    totals = df.groupBy("conv", bucket).agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    before = (Window.partitionBy("conv").orderBy(F.col(bucket).asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col("conv").alias("_conv"), F.col(bucket).alias("_bucket"),
                            *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}")
                              for k in values])
    return local.join(offsets, F.col("conv").eqNullSafe(F.col("_conv"))
                      & F.col(bucket).eqNullSafe(F.col("_bucket"))).withColumns(
        {k: F.col(k) + F.col(f"_{k}") for k in values}).drop(
        "_conv", "_bucket", *[f"_{k}" for k in values])


def rolled(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn once, with its place, and hashes of its conversation up to it."""
    rows = turns.select(
        F.col(id).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("bucket", F.floor(F.col("turn") / SEGMENT))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    placed = running(rows, "bucket", order, {"place": F.lit(1)})
    exact = "decimal(20,0)"
    return running(placed, "bucket", ["place"], {
        "s1": F.xxhash64("place", "role", "text").cast(exact),
        "s2": F.xxhash64("text", "place", "role", F.lit(1)).cast(exact)})


def collapse(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """The turns of maximal conversations: conv, place, role, text, n_turns, copies."""
    rows = stored(rolled(turns, id, turn, role, text))
    lengths = rows.groupBy("conv").agg(F.max("place").alias("n_turns"))
    ends = stored(rows.select("conv", "place", *HASHES).join(
        lengths.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
        .drop("_conv"))
    whole = ends.where("place = n_turns").groupBy("place", *HASHES).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inside = ends.where("place < n_turns").select("place", *HASHES).distinct()
    kept = stored(whole.join(inside, ["place", *HASHES], "left_anti").select(
        F.col("conv").alias("_conv"), F.col("place").alias("n_turns"), "copies"))
    side = F.broadcast(kept) if fits(kept, 10_000) else kept
    return rows.join(side, F.col("conv").eqNullSafe(F.col("_conv"))).select(
        "conv", "place", "role", "text", "n_turns", "copies")


def render(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Text of each segment of at most so many turns of a conversation."""
    piece = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    parts = turns.withColumn("segment", F.floor((F.col("place") - 1) / segment)).groupBy(
        "conv", "segment", "n_turns", "copies").agg(
        F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    return parts.select("conv", "segment", "n_turns", "copies",
                        F.array_join(F.col("pieces")["piece"], "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(collapse(read(spark, sf_dir, "conversations"))).withColumnRenamed(
        "conv", "conv_id")


ORACLE = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM turns),
prefixes AS (
  SELECT *, string_agg(md5(role) || md5(text), '') OVER (
    PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS said FROM placed),
whole AS (
  SELECT said, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes
  WHERE place = n_turns GROUP BY said),
kept AS (
  SELECT * FROM whole WHERE said NOT IN (SELECT said FROM prefixes WHERE place < n_turns))
SELECT p.conv_id, CAST((place - 1) // 256 AS BIGINT) AS segment, n_turns, k.copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                  ORDER BY place) AS text
FROM placed p JOIN kept k ON k.conv_id IS NOT DISTINCT FROM p.conv_id
GROUP BY p.conv_id, (place - 1) // 256, n_turns, k.copies
"""

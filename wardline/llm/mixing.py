"""Mixing sources to target weights, in native expressions.

Sizes are summed per source before anything is shuffled, each source gets a target by
weight that stops at a multiple of its size, and every document is emitted floor(rate) times
plus once more with the remaining probability, drawn from a hash of its id and text.

Defined results. A null text counts no words; a null source is a source of its own and the
last one; a source without words has the target 0 and gives no copies. Repeated rows
draw alike. An empty table gives an empty mix. The mix has the columns of the documents; in the
plan, names that this operator adds replace those that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import count_words, join_bounded, read, share, stored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"


def size_of(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("size", count_words(F.col(text)))


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS,
            most: int = MOST_COPIES) -> DataFrame:
    """Per source: its size, the words the mix should take of it, and the copies per document.

    The table has one row per source. What capped sources can't take goes to the others by
    weight; the level that results is found by passing the sources in the order in which
    they reach their cap: sources before the level are capped, the others share the rest.
    """
    by_source = sizes.groupBy(F.col(source).alias("mix_source")).agg(
        F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("mix_source").isNull(), F.encode("mix_source", "UTF-8"))
    number = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (number % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = (Window.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").isNull(),
                             "mix_source")
              .rowsBetween(Window.unboundedPreceding, -1))
    levels = (ranked
              .withColumn("total", F.sum("source_size").over(everything).cast("double"))
              .withColumn("all_weight", F.sum("weight").over(everything))
              .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", (F.col("total") - F.col("capped"))
                          / (F.col("all_weight") - F.col("used"))))
    # A source is capped if sharing the rest among it and those after it would lift it above.
    over = F.col("level") * F.col("weight") >= F.col("cap")
    free = F.min(F.when(~over, F.struct((F.col("cap") / F.col("weight")).alias("at"),
                                        F.col("level")))).over(everything)
    target = F.when(over, F.col("cap")).otherwise(free["level"] * F.col("weight"))
    return levels.select(
        "mix_source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size"))
        .otherwise(0.0).alias("rate"))


def copies_of(rate: Column, key: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(share(key) < rate - whole, 1).otherwise(0)).cast("int")


def plan_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
             seed: str = SEED) -> DataFrame:
    """Each document with its size, its source's size, target and rate, and its copies."""
    added = ("size", "source_size", "target", "rate", "copies")
    sized = size_of(docs.drop(*[c for c in added if c not in (id, text, source)]), text)
    per_source = stored(targets(sized.select(source, "size"), source, weights, most))
    joined = join_bounded(sized, per_source,
                          lambda t: sized[source].eqNullSafe(t["mix_source"]))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id).cast("string"), F.md5(text),
                                                   F.lit("")))
    return joined.drop("mix_source").withColumn("copies", copies_of(F.col("rate"), key))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        **options) -> DataFrame:
    """The mix: the columns of the documents as they are, one row for each copy taken."""
    wrapped = docs.select(F.struct("*").alias("m_doc"), F.col(id).alias("m_id"),
                          F.col(text).alias("m_text"), F.col(source).alias("m_source"))
    planned = plan_mix(wrapped, "m_id", "m_text", "m_source", **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return planned.where("copies > 0").select("m_doc", copies.alias("m_copy")).select("m_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target",
                          (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The level is the root of a function that only rises, found by passing the caps in order.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1
                 AS DOUBLE) AS w, 3.0 * source_size AS cap FROM per),
tries AS (
  SELECT a.cap / a.w AS lift, sum(CASE WHEN b.cap / b.w <= a.cap / a.w THEN b.cap ELSE 0 END) AS full_cap,
         sum(CASE WHEN b.cap / b.w <= a.cap / a.w THEN 0 ELSE b.w END) AS rest
  FROM (SELECT cap, w FROM weighed UNION ALL SELECT 0, 1) a CROSS JOIN weighed b GROUP BY a.cap / a.w),
level AS (
  SELECT max(((SELECT sum(source_size) FROM per) - full_cap) / rest) AS v FROM tries
  WHERE rest > 0 AND full_cap + lift * rest <= (SELECT sum(source_size) FROM per)),
goal AS (
  SELECT source, source_size, least(cap, coalesce(v, cap / w) * w) AS target FROM weighed, level),
rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(s.doc_id AS VARCHAR), md5(s.text), '')), 1, 13)
              AS BIGINT) / 4503599627370496.0 AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
counted AS (
  SELECT *, CAST(floor(rate) AS INTEGER) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM rated)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM counted
"""

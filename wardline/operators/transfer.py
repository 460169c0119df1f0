"""Governance of text and rows passed from one agent to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import levels as L
from wardline.functions import patterns as P
from wardline.functions.patterns import Pattern
from wardline.functions.text import (
    brand_tags, classify, classify_rank, let, redact_pii, split_chunks)

MODES = ("REDACT", "BLOCK", "AUDIT")


def classify_chunks(text: Column, size: int = P.CHUNK_SIZE,
                    patterns: Sequence[Pattern] = P.PII_PATTERNS,
                    brands: Sequence[str] = P.KNOWN_BRANDS) -> Column:
    """Array of classified chunks of a text."""
    def one(chunk: Column) -> Column:
        return let(classify(chunk, patterns), lambda c: F.struct(
            chunk.alias("text"), c["rank"].alias("sensitivity_rank"),
            (F.size(c["kinds"]) > 0).alias("pii_detected"),
            brand_tags(chunk, brands).alias("brand_tags")))
    return F.transform(split_chunks(text, size), one)


def govern_chunk(chunk: Column, ceiling: Column, mode: str,
                 patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """A classified chunk as the receiver may see it."""
    def result(text: Column, redacted: Column) -> Column:
        return F.struct(text.alias("text"), chunk["sensitivity_rank"].alias("sensitivity_rank"),
                        chunk["pii_detected"].alias("pii_detected"),
                        chunk["brand_tags"].alias("brand_tags"), redacted.alias("redacted"))

    as_is = result(chunk["text"], F.lit(False))
    if mode != "REDACT":
        return as_is
    withheld = result(F.lit(P.ABOVE_CLEARANCE), F.lit(True))
    cleaned = let(redact_pii(chunk["text"], patterns), lambda clean: F.when(
        F.coalesce(classify_rank(clean, patterns) <= ceiling, F.lit(False)),
        result(clean, F.lit(False))).otherwise(withheld))
    return (F.when(F.coalesce(chunk["sensitivity_rank"] <= ceiling, F.lit(False)), as_is)
            .when(chunk["pii_detected"], cleaned).otherwise(withheld))


def safe_text(chunks: Column) -> Column:
    """Text for the receiver, with a notice for each withheld chunk."""
    return F.array_join(F.transform(chunks, lambda c: F.when(
        c["redacted"], F.lit(P.WITHHELD)).otherwise(c["text"])), "\n")


def govern(transfers: DataFrame, text: str, ceiling: str, mode: str = "REDACT",
           size: int = P.CHUNK_SIZE, patterns: Sequence[Pattern] = P.PII_PATTERNS,
           brands: Sequence[str] = P.KNOWN_BRANDS, redact_then_chunk: bool = False) -> DataFrame:
    """Govern the text column of each transfer for a receiver of rank `ceiling`.

    A null text passes as an empty one, and a null ceiling lets nothing pass.

    Adds the governed chunks, their number above the ceiling, the highest level seen,
    `blocked` and `safe_text`. All work stays within the row; nothing is shuffled.
    With `redact_then_chunk`, personal data is replaced before the text is cut whenever the
    whole text is above the ceiling, so a chunk border cannot leave part of a match in clear.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    limit = F.col(ceiling)
    content = F.coalesce(F.col(text), F.lit(""))
    if redact_then_chunk:
        content = F.when(classify_rank(content, patterns) <= limit, content).otherwise(
            redact_pii(content, patterns))
    seen = transfers.withColumn("_seen", classify_chunks(content, size, patterns, brands))
    above = F.size(F.filter("_seen", lambda c: ~F.coalesce(
        c["sensitivity_rank"] <= limit, F.lit(False))))
    out = (seen
           .withColumn("chunks_above", above)
           .withColumn("max_rank_seen", F.coalesce(F.array_max(F.transform(
               "_seen", lambda c: c["sensitivity_rank"])), F.lit(L.PUBLIC)))
           .withColumn("chunks", F.transform(
               "_seen", lambda c: govern_chunk(c, limit, mode, patterns)))
           .drop("_seen")
           .withColumn("redaction_count", F.when(F.lit(mode == "REDACT"), F.col("chunks_above"))
                       .otherwise(F.lit(0)))
           .withColumn("blocked", F.lit(mode == "BLOCK") & (F.col("chunks_above") > 0)))
    if mode == "BLOCK":
        empty = F.array().cast(out.schema["chunks"].dataType)
        out = out.withColumn("chunks", F.when(F.col("blocked"), empty).otherwise(F.col("chunks")))
    return out.withColumn("safe_text", safe_text(F.col("chunks")))


def split_blocked(governed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transfers that pass, and those stopped in BLOCK mode."""
    return governed.where(~F.col("blocked")), governed.where("blocked")


def violations(governed: DataFrame, ceiling: str, keys: Sequence[str]) -> DataFrame:
    """One row per chunk above the receiver's ceiling, for the audit log."""
    return (governed.select(*keys, ceiling, F.posexplode("chunks").alias("chunk_no", "c"))
            .where(~F.coalesce(F.col("c.sensitivity_rank") <= F.col(ceiling), F.lit(False)))
            .select(*keys, "chunk_no", "c.sensitivity_rank", "c.pii_detected", ceiling))


_NEVER_SENSITIVE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _cell_class(column: str, kind: T.DataType, patterns: Sequence[Pattern]) -> Column:
    """Class of a cell; whole numbers and booleans match no pattern and skip the test."""
    if isinstance(kind, _NEVER_SENSITIVE) and patterns is P.PII_PATTERNS:
        return F.when(F.col(column).isNotNull(), F.struct(
            F.lit(L.INTERNAL).alias("rank"), F.array().cast("array<string>").alias("kinds")))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return classify(F.to_json(column), patterns)
    return classify(F.col(column).cast("string"), patterns)


def govern_rows(rows: DataFrame, ceiling: str | int, masked: Sequence[str] = (),
                keep: Sequence[str] = (), patterns: Sequence[Pattern] = P.PII_PATTERNS
                ) -> DataFrame:
    """Rows with masked columns and with cells above the receiver's ceiling replaced.

    Governed columns become strings; a null cell stays null. Columns in `keep` pass as
    they are, for dates that are no birth dates and for keys.
    """
    limit = F.lit(ceiling) if isinstance(ceiling, int) else F.col(ceiling)
    passed = set(keep) | ({ceiling} if isinstance(ceiling, str) else set())

    def cell(field: T.StructField) -> Column:
        if field.name in masked:
            return F.lit(P.MASKED).alias(field.name)
        if field.name in passed:
            return F.col(field.name)
        text = (F.to_json(field.name)
                if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.col(field.name).cast("string"))
        return let(_cell_class(field.name, field.dataType, patterns), lambda c: (
            F.when(c["rank"].isNull() | F.coalesce(c["rank"] <= limit, F.lit(False)), text)
            .when(F.size(c["kinds"]) > 0, P.CELL_PII)
            .otherwise(P.CELL_ABOVE_CLEARANCE))).alias(field.name)

    return rows.select(*[cell(f) for f in rows.schema.fields])


def column_profile(rows: DataFrame, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> DataFrame:
    """Per column: highest level, cells with personal data, cells. One pass over the table."""
    classes = rows.select(*[_cell_class(f.name, f.dataType, patterns).alias(f.name)
                            for f in rows.schema.fields])
    facts = classes.agg(*[F.struct(
        F.lit(c).alias("column_name"),
        F.max(F.col(c)["rank"]).alias("max_rank"),
        F.count_if(F.size(F.col(c)["kinds"]) > 0).alias("pii_cells"),
        F.count(F.col(c)["rank"]).alias("cells")).alias(c) for c in rows.columns])
    return facts.select(F.inline(F.array(*[F.col(c) for c in rows.columns])))

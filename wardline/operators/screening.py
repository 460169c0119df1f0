"""Screening of text columns and rows for injected instructions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import levels as L
from wardline.functions.injection import assess
from wardline.functions.patterns import INJECTION_PATTERNS, Pattern

# Fixed value: shorter strings are not screened in rows.
SHORTEST_FIELD = 11


def screen(df: DataFrame, text: str, block_on: int = L.HIGH,
           layers: Mapping[str, Sequence[Pattern]] = INJECTION_PATTERNS,
           into: str = "assessment") -> DataFrame:
    """Add the assessment of a text column."""
    return df.withColumn(into, assess(F.col(text), block_on, layers))


def split_screened(screened: DataFrame, column: str = "assessment") -> tuple[DataFrame, DataFrame]:
    """Rows that may pass, and rows to quarantine."""
    blocked = F.col(column)["should_block"]
    return screened.where(~blocked), screened.where(blocked)


def screen_rows(df: DataFrame, keys: Sequence[str], block_on: int = L.HIGH,
                layers: Mapping[str, Sequence[Pattern]] = INJECTION_PATTERNS) -> DataFrame:
    """Flagged string fields of a table, one row per row key and column."""
    texts = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name not in keys]
    cells = (df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in texts])).alias("cell"))
        .select(*keys, "cell.*").where(F.length("value") >= SHORTEST_FIELD))
    return (cells.withColumn("assessment", assess(F.col("value"), block_on, layers))
            .where("assessment.risk_rank > 0")
            .select(*keys, "field", "assessment"))


def pattern_report(screened: DataFrame, by: Sequence[str] = (),
                   column: str = "assessment") -> DataFrame:
    """Number of texts per triggered pattern and layer, and per columns `by`."""
    hit = F.explode(F.col(column)["triggered"]).alias("hit")
    return (screened.select(*by, hit)
            .groupBy(*by, F.substring_index("hit", ":", 1).alias("layer"),
                     F.substring_index("hit", ":", -1).alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n_texts")))

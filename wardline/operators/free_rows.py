"""Rows with any keys, held as JSON: masks, governance and screening of nested fields by path.

A row's content is parsed to a VARIANT and walked down to its leaves inside the row, so nothing
is shuffled. Paths read `key`, `key.inner`, `key[0].inner`; a key of other than letters, digits
and underscores is written `['key']`. What lies deeper than `depth` levels is one leaf, its
JSON as text, and so is an empty object or array. Content that is no JSON, or larger than
a VARIANT may be, is one leaf with an empty path; null content has no leaves, and a JSON null is
a leaf without a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.functions import patterns as P
from wardline.functions.injection import assess
from wardline.functions.patterns import Pattern
from wardline.functions.text import any_of, classify, let
from wardline.operators.screening import SHORTEST_FIELD

DEPTH = 6


def _children(leaf: Column) -> Column:
    """The fields or elements of a container, or the leaf itself."""
    path, value = leaf["path"], leaf["value"]

    def named(key: Column) -> Column:
        plain = key.rlike("^[A-Za-z0-9_]+$")
        return (F.when(~plain, F.concat(path, F.lit("['"), key, F.lit("']")))
                .when(path == "", key).otherwise(F.concat(path, F.lit("."), key)))

    def kept(both: Column) -> Column:
        fields = F.transform(F.map_entries(both["fields"]), lambda e: F.struct(
            named(e["key"]).alias("path"), e["value"].alias("value")))
        items = F.transform(both["items"], lambda v, i: F.struct(
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
            v.alias("value")))
        return (F.when(F.size(both["items"]) > 0, items)
                .when(F.size(F.map_keys(both["fields"])) > 0, fields)
                .otherwise(F.array(F.struct(path.alias("path"), value.alias("value")))))

    return let(F.struct(
        F.try_variant_get(value, "$", "array<variant>").alias("items"),
        F.try_variant_get(value, "$", "map<string,variant>").alias("fields")), kept)


def leaves(content: Column, depth: int = DEPTH) -> Column:
    """Array of (path, value, is_text) of the leaves of a JSON text; values are strings."""
    def walked(parsed: Column) -> Column:
        found = F.array(F.struct(F.lit("").alias("path"), parsed.alias("value")))
        for _ in range(depth):
            found = F.flatten(F.transform(found, _children))
        return F.transform(found, lambda leaf: F.struct(
            leaf["path"].alias("path"),
            F.try_variant_get(leaf["value"], "$", "string").alias("value"),
            (F.schema_of_variant(leaf["value"]) == "STRING").alias("is_text")))

    whole = F.array(F.struct(F.lit("").alias("path"), content.alias("value"),
                             F.lit(True).alias("is_text")))
    return F.when(content.isNotNull(), let(F.try_parse_json(content), lambda v: F.when(
        v.isNull(), whole).otherwise(walked(v))))


def _below(leaf: Column, fields: Sequence[str]) -> Column:
    """Whether a leaf is one of the fields, lies inside one, or is JSON that may hold one."""
    path, whole = leaf["path"], leaf["value"].rlike(r"^[\[{]") & ~leaf["is_text"]
    inside = [(path == f) | path.startswith(f + ".") | path.startswith(f + "[") for f in fields]
    around = [F.lit(f).startswith(F.concat(path, F.lit(end))) for f in fields for end in ".["]
    return F.coalesce(any_of(inside) | (whole & any_of(around)), F.lit(False))


def govern_free_rows(rows: DataFrame, content: str, ceiling: str | int,
                     masked: Sequence[str] = (), dropped: Sequence[str] = (),
                     patterns: Sequence[Pattern] = P.PII_PATTERNS,
                     depth: int = DEPTH) -> DataFrame:
    """Add `fields`: path, value and reason of each leaf as a receiver of rank `ceiling` sees it.

    `masked` and `dropped` name keys or paths, and hold for all that lies below them and for
    leaves that are too deep to be walked and may hold them. A value above the ceiling is replaced, by one text for personal data and another for the rest; the
    reason is MASKED, PII, ABOVE_CLEARANCE or null. A null ceiling lets only masks and nulls pass.
    """
    limit = F.lit(ceiling) if isinstance(ceiling, int) else F.col(ceiling)

    def shown(leaf: Column) -> Column:
        def reason(c: Column) -> Column:
            return (F.when(_below(leaf, masked), "MASKED")
                    .when(c["rank"].isNull() | F.coalesce(c["rank"] <= limit, F.lit(False)),
                          F.lit(None).cast("string"))
                    .when(F.size(c["kinds"]) > 0, "PII").otherwise("ABOVE_CLEARANCE"))

        return let(let(classify(leaf["value"], patterns), reason), lambda r: F.struct(
            leaf["path"].alias("path"),
            F.when(r == "MASKED", P.MASKED).when(r == "PII", P.CELL_PII)
            .when(r == "ABOVE_CLEARANCE", P.CELL_ABOVE_CLEARANCE)
            .otherwise(leaf["value"]).alias("value"), r.alias("reason")))

    seen = leaves(F.col(content), depth)
    if dropped:
        seen = F.filter(seen, lambda leaf: ~_below(leaf, dropped))
    return rows.withColumn("fields", F.transform(seen, shown))


def screen_free_rows(rows: DataFrame, content: str, keys: Sequence[str],
                     block_on: int = L.HIGH, depth: int = DEPTH) -> DataFrame:
    """Flagged texts inside the rows, one row per key columns and path, with the assessment."""
    texts = F.filter(leaves(F.col(content), depth), lambda leaf: (
        leaf["is_text"] & (F.length(leaf["value"]) >= SHORTEST_FIELD)))
    return (rows.select(*keys, F.explode(texts).alias("leaf"))
            .select(*keys, "leaf.path", assess(F.col("leaf.value"), block_on).alias("assessment"))
            .where("assessment.risk_rank > 0"))

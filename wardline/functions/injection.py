"""Screening of text for injected instructions, as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.functions.patterns import INJECTION_PATTERNS, Pattern
from wardline.functions.text import let, matches, text_forms

# Rank and confidence of one hit and of two or more hits per layer.
LAYER_SCORES = {
    "critical": ((L.CRITICAL, 0.95), (L.CRITICAL, 0.95)),
    "boundary": ((L.MEDIUM, 0.60), (L.HIGH, 0.80)),
    "tool_redirect": ((L.MEDIUM, 0.55), (L.HIGH, 0.75)),
    "delimiter": ((L.HIGH, 0.85), (L.HIGH, 0.85)),
}
CLEAN_CONFIDENCE = 0.95
EXPLAINED_PATTERNS = 5


def triggered_patterns(text: Column,
                       layers: Mapping[str, Sequence[Pattern]] = INJECTION_PATTERNS) -> Column:
    """Names `layer:pattern` of the patterns in a text, in report order."""
    def body(forms: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(matches(p, forms), F.lit(f"{layer}:{p.name}"))
            for layer, patterns in layers.items() for p in patterns]))
    return let(text_forms(F.coalesce(text, F.lit(""))), body)


def score(triggered: Column, block_on: int = L.HIGH) -> Column:
    """Assessment struct from the names of triggered patterns."""
    def hits(layer: str) -> Column:
        return F.size(F.filter(triggered, lambda t: t.startswith(f"{layer}:")))

    def best(slot: int, nothing: float) -> Column:
        parts = [F.when(hits(layer) >= 2, F.lit(two[slot])).when(hits(layer) == 1, F.lit(one[slot]))
                 .otherwise(F.lit(nothing)) for layer, (one, two) in LAYER_SCORES.items()]
        return F.greatest(*parts)

    def body(rank: Column) -> Column:
        extra = F.size(triggered) - EXPLAINED_PATTERNS
        summary = F.concat(
            F.array_join(F.slice(triggered, 1, EXPLAINED_PATTERNS), ", "),
            F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(" more)")))
            .otherwise(F.lit("")))
        risk = L.rank_to_name(rank, L.INJECTION_RISKS)
        return F.struct(
            risk.alias("risk"),
            rank.alias("risk_rank"),
            F.when(F.size(triggered) == 0, F.lit(CLEAN_CONFIDENCE))
            .otherwise(best(1, 0.0)).alias("confidence"),
            triggered.alias("triggered"),
            F.when(F.size(triggered) == 0, F.lit("Nothing suspicious was found.")).otherwise(
                F.concat(F.lit("Risk of injection is "), risk, F.lit(": it matches ["), summary,
                         F.lit("] and may steer an agent.")))
            .alias("explanation"),
            (rank >= min(block_on, L.HIGH)).alias("should_block"))

    return let(best(0, L.NONE), body)


def assess(text: Column, block_on: int = L.HIGH,
           layers: Mapping[str, Sequence[Pattern]] = INJECTION_PATTERNS) -> Column:
    """Risk, confidence, triggered patterns, explanation and blocking of a text."""
    return let(triggered_patterns(text, layers), lambda t: score(t, block_on))

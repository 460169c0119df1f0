"""Sensitivity classification, personal data and redaction as native column expressions.

All functions map a string column to a column and read the whole text. Texts stay
in the JVM and no function shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.functions import patterns as P
from wardline.functions.patterns import Pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def fold_case(lowered: Column) -> Column:
    """Lower-cased text with the letters that match s and i when case is ignored."""
    for letter, plain in (("ſ", "s"), ("ı", "i"), ("i̇", "i")):
        lowered = F.replace(lowered, F.lit(letter), F.lit(plain))
    return lowered


def matches(pattern: Pattern, forms: Column) -> Column:
    """Whether a pattern occurs; cheap literal tests go before the expression."""
    text, folded = forms["text"], forms["fold"]
    hints = [any_of([F.contains(folded, F.lit(w)) for w in words]) for words in pattern.hints]
    found = text.rlike(pattern.detector())
    if pattern.has_edges:
        found = F.when(forms["odd"], text.rlike(pattern.detector(True))).otherwise(found)
    return all_of([*hints, found])


def text_forms(text: Column) -> Column:
    """A text with what all its tests share."""
    lowered = F.lower(text)
    return F.struct(text.alias("text"), lowered.alias("low"), fold_case(lowered).alias("fold"),
                    has_odd_edges(text).alias("odd"))


def has_odd_edges(text: Column) -> Column:
    """Whether word edges need the exact rule; never in text of one byte per character."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(P.ODD_EDGES)


def _kinds(forms: Column, patterns: Sequence[Pattern]) -> Column:
    def found(some: Sequence[Pattern]) -> Column:
        names = [F.when(matches(p, forms), F.lit(p.name)) for p in some]
        return F.array_compact(F.array(*names).cast("array<string>"))

    no_digit = [p for p in patterns if p.name not in P.DIGIT_PII]
    return F.when(forms["text"].rlike(r"(?U)\d"), found(patterns)).otherwise(found(no_digit))


def _classified(forms: Column, kinds: Column) -> Column:
    low = forms["low"]
    restricted = any_of([F.array_contains(kinds, k) for k in P.RESTRICTED_PII]
                        + [F.contains(low, F.lit(w)) for w in P.RESTRICTED_KEYWORDS])
    confidential = any_of([F.size(kinds) > 0]
                          + [F.contains(low, F.lit(w)) for w in P.CONFIDENTIAL_KEYWORDS]
                          + [matches(P.CURRENCY, forms)])
    return (F.when(restricted, F.lit(L.RESTRICTED)).when(confidential, F.lit(L.CONFIDENTIAL))
            .otherwise(F.lit(L.INTERNAL)))


def classify(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """Struct of sensitivity rank and the kinds of personal data found; null for null text."""
    def body(forms: Column) -> Column:
        return let(_kinds(forms, patterns), lambda kinds: F.struct(
            _classified(forms, kinds).alias("rank"), kinds.alias("kinds")))
    return F.when(text.isNotNull(), let(text_forms(text), body))


def classify_rank(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """Sensitivity rank of a text."""
    return classify(text, patterns)["rank"]


def pii_kinds(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """Names of the kinds of personal data in a text, in pattern order."""
    return F.when(text.isNotNull(), let(text_forms(text), lambda forms: _kinds(forms, patterns)))


def detect_pii(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """Whether a text holds personal data."""
    return F.size(pii_kinds(text, patterns)) > 0


def brand_tags(text: Column, brands: Sequence[str] = P.KNOWN_BRANDS) -> Column:
    """Brands that occur in a text in any letter case, in list order."""
    def body(low: Column) -> Column:
        return F.array_compact(F.array(
            *[F.when(F.contains(low, F.lit(b.lower())), F.lit(b)) for b in brands]))
    return F.when(text.isNotNull(), let(F.lower(text), body))


def redact_pii(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """Replace each kind of personal data in turn by its placeholder."""
    def replaced(some: Sequence[Pattern], exact_edges: bool) -> Column:
        out = text
        for p in some:
            out = _replace_kind(out, p, exact_edges)
        return out

    # A narrower detector may need a digit where the replacement does not.
    no_digit = [p for p in patterns if p.name not in P.DIGIT_PII or p.detect_regex]
    return (F.when(has_odd_edges(text), replaced(patterns, True))
            .when(text.rlike(r"(?U)\d"), replaced(patterns, False))
            .otherwise(replaced(no_digit, False)))


def _replace_kind(text: Column, pattern: Pattern, exact_edges: bool) -> Column:
    def body(now: Column) -> Column:
        letters = any(c.isalpha() for words in pattern.hints for w in words for c in w)
        folded = fold_case(F.lower(now)) if letters else now
        hints = [any_of([F.contains(folded, F.lit(w)) for w in ws]) for ws in pattern.hints]
        done = F.regexp_replace(now, pattern.flagged(exact_edges=exact_edges),
                                f"[REDACTED:{pattern.name.upper()}]")
        return F.when(all_of(hints), done).otherwise(now) if hints else done
    return let(text, body)


def split_chunks(text: Column, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """Array of overlapping windows over a text, counted in characters.

    The text is cut once into pieces of one step, and each window joins the pieces
    it spans, so the work grows with the length of the text.
    """
    step = size - overlap if size > overlap else size
    spanned = -(-size // step)
    rest = F.greatest(F.length(text) - size, F.lit(0))
    count = F.ceil(rest / F.lit(step)).cast("int") + 1

    def windows(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), count), lambda k: F.substring(
            F.array_join(F.slice(pieces, k, F.lit(spanned)), ""), 1, size))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(
        F.length(text) <= size, F.array(text)).when(text.isNotNull(), let(pieces, windows))


def as_text(content: Column, is_structured: bool) -> Column:
    """Content as text: structured values as JSON, others as their string form."""
    return F.to_json(content) if is_structured else content.cast("string")

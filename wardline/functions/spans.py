"""Places of personal data in a text, as native column expressions.

Each kind in turn claims its matches, and what is claimed can't be matched again. Claimed
characters become marks of the same number, so that all places are those of the text as it
came, and overlaps are settled as redaction settles them. One reading of the marked text yields
the spans of all kinds in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import patterns as P
from wardline.functions.patterns import Pattern
from wardline.functions.text import has_odd_edges, let

#: Marks are private characters, two for each kind: the first of a match and all others.
FIRST_MARK = 0xE000
#: What private characters of the text that look like marks are read as.
PLAIN = "\uf8ff"
BLOCK = 256


def _marks(patterns: Sequence[Pattern]) -> tuple[str, str]:
    """The first and the further marks of all kinds."""
    every = [chr(FIRST_MARK + i) for i in range(2 * len(patterns))]
    return "".join(every[0::2]), "".join(every[1::2])


def _claim(text: Column, pattern: Pattern, number: int, exact_edges: bool) -> Column:
    """A text whose matches of a pattern are marks."""
    regex = pattern.flagged(exact_edges=exact_edges)
    first, more = chr(FIRST_MARK + 2 * number), chr(FIRST_MARK + 2 * number + 1)

    def body(now: Column) -> Column:
        def marked(found: Column) -> Column:
            mark = F.transform(found, lambda m: F.concat(
                F.lit(first), F.repeat(F.lit(more), F.length(m) - 1)))
            return let(mark, lambda marks: F.array_join(F.transform(
                F.split(now, regex, -1),
                lambda piece, i: F.concat(piece, F.coalesce(F.get(marks, i), F.lit("")))), ""))
        return F.when(now.rlike(regex), let(
            F.regexp_extract_all(now, F.lit(regex), F.lit(0)), marked)).otherwise(now)

    return let(text, body)


def marked_text(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """The text with marks in place of personal data, of the same length."""
    starts, more = _marks(patterns)
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.translate(text, starts + more, PLAIN * len(starts + more)))

    def all_kinds(exact_edges: bool, digits: bool) -> Callable[[Column], Column]:
        def body(now: Column) -> Column:
            for number, pattern in enumerate(patterns):
                # A narrower detector may need a digit where the replacement does not.
                if digits or pattern.name not in P.DIGIT_PII or pattern.detect_regex:
                    now = _claim(now, pattern, number, exact_edges)
            return now
        return body

    return let(plain, lambda t: F.when(has_odd_edges(t), all_kinds(True, True)(t)).when(
        t.rlike(r"(?U)\d"), all_kinds(False, True)(t)).otherwise(all_kinds(False, False)(t)))


def sums_before(numbers: Column, block: int = BLOCK) -> Column:
    """For each number of an array the sum of all before it.

    Sums of blocks keep the work near to linear in the length of the array.
    """
    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x)

    def body(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last),
                           lambda b: total(F.slice(values, b * block + 1, F.lit(block))))
        before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(before, lambda known: F.transform(values, lambda _, i: (
            F.get(known, F.floor(i / block).cast("int"))
            + total(F.slice(values, i - i % block + 1, i % block)))))

    return F.when(F.size(numbers) > 0, let(numbers, body)).otherwise(
        F.array().cast("array<bigint>"))


def pii_spans(text: Column, patterns: Sequence[Pattern] = P.PII_PATTERNS) -> Column:
    """Array of (kind, start, end) in the order of the text; spans don't overlap.

    Places count characters from 0, and `end` is one past the last. Replacing each span by the
    placeholder of its kind gives `redact_pii`. An empty array where there is none, null for
    a null text.
    """
    starts, more = _marks(patterns)
    names = F.array(*[F.lit(p.name) for p in patterns])
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")

    def cut(runs: Column) -> Column:
        lengths = F.transform(runs, lambda r: F.length(r).cast("long"))

        def spans(offsets: Column) -> Column:
            named = F.transform(runs, lambda r, i: F.struct(
                F.get(names, F.floor((F.ascii(F.substring(r, 1, 1)) - FIRST_MARK) / 2)
                      .cast("int")).alias("kind"),
                F.get(offsets, i).alias("start"),
                (F.get(offsets, i) + F.length(r)).alias("end")))
            return F.filter(named, lambda s: s["kind"].isNotNull())
        return let(sums_before(lengths), spans)

    def body(marked: Column) -> Column:
        run = f"[{starts}][{more}]*|[^{starts}{more}]+"
        return F.when(marked.rlike(f"[{starts}]"), let(
            F.regexp_extract_all(marked, F.lit(run), F.lit(0)), cut)).otherwise(none)

    return F.when(text.isNotNull(), let(marked_text(text, patterns), body))

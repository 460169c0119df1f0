import math
import zlib
from collections import Counter, defaultdict

import pytest
from cases import EDGES

from wardline.llm import katz


def plain(rows):
    """The model and its scores from dictionaries."""
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    def learns(id):
        return id is None or zlib.crc32(str(id).encode()) % 7 != 2

    one, two, total = Counter(), Counter(), Counter()
    for id, text in rows:
        before = "<s>"
        for w in tokens(text) if learns(id) else ():
            one[w] += 1
            two[before, w] += 1
            total[before] += 1
            before = w
    n = sum(one.values())
    d1, d2 = (katz.discounts(Counter(c.values())) for c in (one, two))

    def kept(d, c):
        return (d[c] if c <= katz.CUT else 1.0) * c

    unknown = 1 - sum(kept(d1, c) for c in one.values()) / n if n else 1.0
    events = n
    if n and unknown <= 1e-12:
        events, unknown = n + 1, 1 / (n + 1)

    def p1(w):
        return kept(d1, one[w]) / events if w in one else unknown

    after = defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))
    room = {h: total[h] + (not any(c <= katz.CUT for _, c in x)) for h, x in after.items()}
    alpha = {h: (1 - sum(kept(d2, c) for _, c in x) / room[h]) / (1 - sum(p1(w) for w, _ in x))
             for h, x in after.items()}
    for h in list(after)[:20]:  # each level sums to 1
        rest = unknown + sum(p1(w) for w in one if (h, w) not in two)
        assert sum(kept(d2, c) / room[h] for _, c in after[h]) + alpha[h] * rest == pytest.approx(1)
    result = []
    for id, text in rows:
        before, score, base, found = "<s>", 0.0, 0.0, tokens(text)
        for w in found:
            base += math.log10((one[w] + 1) / (n + len(one) + 1))
            c = two.get((before, w), 0)
            score += math.log10(kept(d2, c) / room[before] if c else alpha.get(before, 1.0) * p1(w))
            before = w
        result.append((id, not learns(id), len(found), sum(w in one for w in found), n, base, score))
    return sorted(result, key=repr)


def check(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    for g, w in zip(got, plain(rows), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


@pytest.mark.parametrize("parts, tokens", [(1, 10**6), (7, 5000), (64, 30_000)])
def test_scores(documents, parts, tokens):
    """Few and many parts; with many, frequent histories are split."""
    check(katz.score(documents, parts=parts, tokens=tokens),
          [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_frequent_pairs_only(spark):
    """No rare counts at all: the extra event makes room."""
    rows = [(i, "a b a b") for i in range(40)] + [(2, "a c")]
    rows = [(i, t) for i, t in rows if t == "a b a b" or zlib.crc32(b"2") % 7 == 2] + [(15, "b a x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 16):
        check(katz.score(docs, parts=parts, tokens=50), rows)


def test_edges(edges, nothing, spark):
    check(katz.score(edges, parts=5, tokens=20_000), [r[:2] for r in EDGES])
    assert katz.score(nothing, parts=3).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    untrained = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), parts=2)
    assert [tuple(r) for r in untrained.collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]

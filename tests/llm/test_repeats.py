"""Repeated byte strings against counting every window."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from wardline.llm import common, repeats


def brute(texts, size):
    """Per text (removed, spans, kept)."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    found = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                gone[i + 1:i + 1 + size] = True
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        found.append((int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), kept))
    return found


def drawn(seed):
    draw = random.Random(seed)
    letters = draw.choice(["ab", "abcdef", "aé中"])
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 90))) for _ in range(25)]
    texts += [None, "", "x" * 60, "xy" * 40, texts[0], texts[0], texts[1][5:] + "tail"]
    return texts + [draw.choice(texts[:25])[:k] for k in (20, 40, 60)]


@pytest.mark.parametrize("seed", range(40))
def test_expansion(seed):
    draw = random.Random(seed)
    letters = draw.choice([b"ab", b"abcdef", b"\0\1\xff"])
    texts = [bytes(draw.choices(letters, k=draw.randint(0, 50))) for _ in range(draw.randint(1, 9))]
    size = draw.randint(2, 12)
    seen = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    for t, runs in zip(texts, repeats.repeating_runs(texts, [1] * len(texts), size)):
        flags = [0, *[int(seen[t[i:i + size]] > 1) for i in range(len(t) - size + 1)], 0]
        assert runs == np.flatnonzero(np.diff(flags)).tolist()


@pytest.mark.parametrize("seed", range(20))
def test_parts_cover_each_window_once(seed):
    draw = random.Random(seed)
    data = np.array(draw.choices(range(draw.choice([1, 2, 90])), k=draw.randint(0, 900)), np.uint8)
    cut = draw.randint(0, len(data))
    starts, ends = np.array([0, cut]), np.array([cut, len(data)])
    for gram in (5, 11, 12):
        first, counts, marks = repeats.find_parts(data, starts, ends, gram, 12)
        covered = [i for f, c in zip(first, counts) for i in range(f, f + c)]
        assert covered == [i for a, b in zip(starts, ends) for i in range(a, b - 11)]
        by_window, places = {}, set()
        for f, c, m in zip(first, counts, marks):
            own = [data[i:i + 12].tobytes() for i in range(f, f + c)]
            assert len(set(own)) == c
            assert all(by_window.setdefault(w, m) == m for w in own)


@pytest.mark.parametrize("seed, block", [(1, 1_000_000), (2, 1_000_000), (3, 40), (4, 1)])
def test_documents(spark, seed, block):
    texts = drawn(seed)
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, a int")
    got = repeats.remove(docs, size=16, grams=(6, 12, 16), block=block).collect()
    expected = brute([r[1] for r in rows], 16)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"],
                   bytes(r["kept"])) for r in got) == sorted(
        (repr(r[0]), len((r[1] or "").encode()), *e) for r, e in zip(rows, expected))
    for r in got:
        assert sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"]


def test_long_texts_are_read_in_stretches(spark):
    draw = random.Random(5)
    long = "".join(draw.choices("abcdefgh ", k=1_300_000))
    passage = long[524_100:525_100]
    docs = spark.createDataFrame([(1, long), (2, "q" * 300 + passage + "z" * 250)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.remove(docs).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], list(got[1]["spans"])) == (
        1000, 1, [524_100, 525_100])
    assert list(got[2]["spans"]) == [0, 1550]


def test_crowded_marks_shuffle_no_text_again_and_steps_are_deleted(spark, monkeypatch):
    packs, whole = [], repeats.packed
    monkeypatch.setattr(repeats, "packed", lambda *a: packs.append(a[1:]) or whole(*a))
    folder = os.path.dirname(common.shared_folder(spark)).removeprefix("file:")
    before = set(os.listdir(folder))
    texts = drawn(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.remove(docs, size=16, grams=(6, 12, 16), block=1)
    left = [x for x in set(os.listdir(folder)) - before if x.startswith("llm-")]
    assert sorted((r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == sorted(
        brute(texts, 16))
    # Once on each of the three levels for the classes, and once for what is returned.
    assert packs == [("a", "b")] * 3 + [("id", "a", "b")]
    assert len(left) == 1


def test_edges(spark, edges, nothing):
    got = repeats.remove(edges).collect()
    expected = brute([r["text"] for r in edges.collect()], 200)
    assert sorted((r["n_removed"], r["n_spans"], hashlib.md5(r["kept"]).hexdigest())
                  for r in got) == sorted((a, b, hashlib.md5(k).hexdigest()) for a, b, k in expected)
    assert repeats.remove(nothing).count() == 0

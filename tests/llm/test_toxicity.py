import random

import numpy as np
import pytest
from cases import EDGES

from wardline.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["idiot", "scum", "loweiung", "loweiheit", "loweikeit"]
    rows = []
    for i in range(n):
        found = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
                 for _ in range(rng.randint(5, 200))]
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            found.insert(rng.randrange(len(found)), rng.choice(bad))
        rows.append((i, " ".join(found), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = corpus(400, 1)
    return tx.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def test_held_out_texts(net):
    rows = corpus(150, 2)
    scores = tx.score_texts([t for _, t, _ in rows], net)
    labels = np.array([y for *_, y in rows])
    assert ((scores >= 0.5) == labels).mean() > 0.95
    assert scores[labels == 1].mean() > scores[labels == 0].mean() + 0.5


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        words = tx.Words([" ".join(f"w{i}" for i in range(n)), "x y"])
        windows, owner = words.windows()
        own = windows[owner == 0]
        assert len(np.unique(own[own > 0])) == n and len(own) >= 1


def test_slopes():
    """The gradient agrees with differences of the loss."""
    texts = ["you idiot are here", "plain words of text here now", "a b"]
    labels = np.array([1.0, 0.0, 0.0], dtype=np.float32)
    words = tx.Words(texts)
    windows, owner = words.windows()
    rng = np.random.default_rng(0)
    h, e = tx.HIDDEN, tx.EMBED
    net = {"words": rng.normal(0, .3, (tx.WORD_ROWS, e)), "grams": rng.normal(0, .3, (tx.GRAM_ROWS, e)),
           "att": rng.normal(0, .3, (2 * h, h)), "att_v": rng.normal(0, .3, h),
           "out": rng.normal(0, .3, 2 * h), "out_b": np.zeros(1)}
    for d in "fb":
        net |= {f"in_{d}": rng.normal(0, .3, (2 * e, 3 * h)), f"u_{d}": rng.normal(0, .3, (h, 3 * h)),
                f"b_{d}": np.zeros(3 * h)}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    weight = np.ones(3, dtype=np.float32)

    def loss(n):
        s = tx.logits(words.vectors(n), windows, n).astype(float)
        return float(np.mean(np.log1p(np.exp(s)) - labels * s))

    found = tx.slopes(net, words, windows, labels, weight)
    for name in ("out", "att", "att_v", "u_f", "u_b", "in_f", "in_b", "b_f", "out_b"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        up, down = ({**net, name: net[name].copy()} for _ in range(2))
        up[name][at] += 0.02
        down[name][at] -= 0.02
        assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 0.04, rel=0.05, abs=1e-4)


def test_sample_leaves_held_out_rows_and_doubtful_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(80)] + [(0, 1), (3, None)], "doc_id long, toxic int")
    import zlib
    picked = tx.chosen(docs, labels).collect()
    want = {f"t{i}": max(i % 2, int(i == 0)) for i in range(80) if zlib.crc32(str(i).encode()) % 5}
    assert {r["d_text"]: r["p_label"] for r in picked} == want


def test_edges(edges, nothing, net, spark):
    scored = tx.score(edges, net)
    assert "m_doc" in scored.columns and scored.columns.count("score") == 1
    rows = scored.collect()
    assert len(rows) == len(EDGES)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert tx.score(nothing, net).count() == 0
    one_class = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    left = tx.keep_clean(edges, one_class)
    assert left.columns == edges.columns and left.count() == len(EDGES)
    assert left.where("score NOT LIKE 'score-%'").count() == 0
    assert tx.keep_clean(nothing, one_class.limit(0)).count() == 0

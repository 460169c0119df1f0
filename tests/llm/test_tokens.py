import dataclasses
import random
import time

import numpy as np
import pytest
from cases import EDGES

from wardline.llm import sentencepiece as sp
from wardline.llm import token_counts as tc

TEXTS = [r[1] or "" for r in EDGES] + ["  ", "a  b\n\n c", "don't we've  x<|endoftext|>y\t\tz \n a",
                                       " lead", "trail ", "é​ a", "1 2  3.14 -- '' ' s"]


@pytest.fixture(scope="module")
def encoder():
    return tc.tokenizer(tc.vocabulary(tc.VOCABULARY))


def test_counts_are_those_of_the_library(documents, encoder):
    rows = documents.select("doc_id", "text").collect()
    want = [len(e.ids) for e in encoder.encode_batch([r["text"] for r in rows],
                                                     add_special_tokens=False)]
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(documents).collect()}
    assert [got[r["doc_id"]] for r in rows] == want


@pytest.mark.parametrize("chunk, overlap", [(200, 20), (1000, 64), (500, 5)])
def test_spliced_chunks_equal_the_whole(documents, encoder, chunk, overlap):
    rng = random.Random(chunk)
    pool = [r["text"] for r in documents.limit(40).collect()] + TEXTS[:9]
    for _ in range(12):
        text = " ".join(rng.choice(pool)[:rng.randrange(500)] for _ in range(12)) + rng.choice(
            ["", "  \n"]) + "y" * rng.choice([0, 3000]) + rng.choice(TEXTS[-7:])
        want = encoder.encode(text, add_special_tokens=False).ids
        assert tc.huge_ids(encoder, text, chunk, overlap).tolist() == want


def test_count_edges(edges, nothing, encoder):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"])
                 for r in tc.count_tokens(edges).collect())
    want = sorted((r[0] or 0, len((r[1] or "").encode()), n, n > 512) for r in EDGES
                  for n in [len(encoder.encode(r[1] or "", add_special_tokens=False).ids)])
    assert got == want and tc.count_tokens(nothing).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sp.automaton(sp.vocabulary(sp.MODEL))


def best_score(auto, text):
    """The best sum of scores by trying every piece at every place."""
    raw = (sp.MARK + text.replace(" ", sp.MARK)).encode()
    score = {p: auto.score[i] for i, p in enumerate(_names(auto)) if p is not None}
    best = [0.0] + [-np.inf] * len(raw)
    for end in range(1, len(raw) + 1):
        for start in range(max(0, end - 60), end):
            if raw[start:end] in score:
                best[end] = max(best[end], best[start] + score[raw[start:end]])
        if end == len(raw) or (raw[end] & 0xC0) != 0x80:
            start = end - 1
            while (raw[start] & 0xC0) == 0x80:
                start -= 1
            if raw[start:end] not in score:
                best[end] = max(best[end], best[start] + auto.unknown)
    return best[-1]


def _names(auto):
    return [auto.pieces[i] if i >= 0 else None for i in auto.piece]


def score_of(auto, ids):
    by_piece = {int(p): s for p, s in zip(auto.piece, auto.score) if p >= 0}
    total, at = 0.0, 0
    while at < len(ids):
        if ids[at] in by_piece:
            total, at = total + by_piece[ids[at]], at + 1
        else:
            lead = auto.pieces[ids[at]][0]
            total, at = total + auto.unknown, at + (1 if lead < 0x80 else 2 if lead < 0xE0
                                                    else 3 if lead < 0xF0 else 4)
    return total


def test_paths_are_best(pieces, documents):
    texts = [t for t in TEXTS if t and len(t) < 1000]
    texts += [r["text"][:300] for r in documents.limit(15).collect()]
    for text, ids in zip(texts, sp.encode_texts(pieces, texts).to_pylist()):
        assert score_of(pieces, ids) == pytest.approx(best_score(pieces, text)), text


def test_same_scores_as_the_library(pieces, documents):
    """Words against the lattice of the library, which lists the best paths of a unigram model.

    Its quick encoder takes some worse paths, so the ids are held against the lattice.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(sp.vocabulary(sp.MODEL), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1  # the pieces and scores as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    found = sorted({w for r in documents.limit(40).collect() for w in r["text"].split()})[:1500]
    found += [" ".join(found[i:i + 3]) for i in range(0, 300, 3)]
    for word, ids in zip(found, sp.encode_texts(pieces, found).to_pylist()):
        if not any(pieces.first_byte <= i < pieces.first_byte + 256 for i in ids):
            best = library.nbest_encode(word, nbest_size=2)[0]
            assert score_of(pieces, ids) == score_of(pieces, best), word


def test_round_trip(edges, nothing, documents):
    for docs in (edges, documents):
        back = sp.decode(sp.encode(docs))
        want = sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
        assert sorted((r["doc_id"] or 0, r["decoded"]) for r in back.collect()) == want
    assert sp.decode(sp.encode(nothing)).count() == 0


def test_long_units_are_read_alone():
    """One unit by itself has the path that units side by side have."""
    auto = sp.automaton(sp.vocabulary(sp.MODEL))
    draw = random.Random(7)
    for letters in ("x", "abcdefgéü中😀", "the of and"):
        raw = "".join(draw.choices(letters, k=3000)).encode()
        table = np.frombuffer(raw, np.uint8)[:, None].copy()
        ids, counts = sp.best_paths(auto, table, np.array([len(raw)]))
        assert ids.tolist() == sp.best_path(auto, raw) and counts.tolist() == [len(ids)]
    start = time.perf_counter()
    text = "x" * 1_000_000
    ids = sp.encode_texts(auto, [text])[0].values.to_numpy()
    assert sp.decode_ids(auto, ids) == text and time.perf_counter() - start < 20


def test_pieces_that_cross_units():
    """With a vocabulary whose pieces cross marks, texts are not cut."""
    auto = sp.automaton(sp.vocabulary(sp.MODEL))
    assert auto.splits
    whole = dataclasses.replace(auto, splits=False)
    texts = ["one two  three", "", "a" * 5000 + " b", " lead"]
    assert sp.encode_texts(whole, texts).to_pylist() == sp.encode_texts(auto, texts).to_pylist()

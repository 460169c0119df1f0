"""Encoding and decoding with SentencePiece models: Aho-Corasick and a single-pass Viterbi.

An automaton over the bytes of all pieces reads a text once; at each position the output links
give every piece that ends there, and the best score of the position is relaxed from the
score where the piece starts. Equal scores go to the longer piece, as in the library. A
character without a piece costs the unknown penalty and becomes byte pieces.

Where no piece holds a space mark after another character, the best path of a text is the chain
of the best paths of its units, each a run of space marks with the characters that follow;
with other vocabularies a text is one unit. The different units of a slice are read side by
side, position by position, in numpy; a unit of more than `LONG` bytes is read alone.

Defined results. Null and empty texts have no pieces; a text is decoded as it was, but for the
mark U+2581 itself, which comes back as a blank; other columns of the documents are not carried,
empty tables give empty tables, and repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import distinct, giving_back, slices
from wardline.llm.common import read, ship
from wardline.llm.token_counts import vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CELLS = 1 << 19
LONG = 2048
SLICE_BYTES = 2 << 20
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Automaton:
    """Trie arcs as sorted keys (node * 256 + byte), failure and output links, outputs."""

    keys: np.ndarray
    targets: np.ndarray
    root: np.ndarray
    fail: np.ndarray
    link: np.ndarray
    piece: np.ndarray
    length: np.ndarray
    score: np.ndarray
    unknown: float
    first_byte: int
    pieces: list[bytes]
    #: Whether no piece crosses the beginning of a unit.
    splits: bool

    @cached_property
    def plain(self) -> tuple:
        """Arcs as a dictionary and the other arrays as lists, to read single units."""
        return (dict(zip(self.keys.tolist(), self.targets.tolist())), *(x.tolist() for x in (
            self.root, self.fail, self.link, self.piece, self.length, self.score)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, following failure links until an arc fits or the root is left."""
        result = self.root[byte]
        todo = np.flatnonzero(state)
        at = state[todo]
        while len(todo):
            key = at.astype(np.int64) * 256 + byte[todo]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            result[todo[hit]] = self.targets[place[hit]]
            todo, at = todo[~hit], self.fail[at[~hit]]
            todo, at = todo[at > 0], at[at > 0]
        return result


@cache
def automaton(path: str) -> Automaton:
    """Built from the normal pieces of a model file."""
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i)
                                            or model.is_byte(i) or model.is_unused(i))]
    children: list[dict[int, int]] = [{}]
    piece, length, score = [-1], [0], [0.0]
    for i in plain:
        node = 0
        raw = model.id_to_piece(i).encode()
        for byte in raw:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                piece.append(-1)
                length.append(0)
                score.append(0.0)
            node = children[node][byte]
        piece[node], length[node], score[node] = i, len(raw), model.get_score(i)
    fail, link = [0] * len(children), [0] * len(children)
    queue = deque(children[0].values())
    while queue:
        node = queue.popleft()
        for byte, child in children[node].items():
            queue.append(child)
            back = fail[node]
            while back and byte not in children[back]:
                back = fail[back]
            fail[child] = children[back].get(byte, 0)
            link[child] = fail[child] if piece[fail[child]] >= 0 else link[fail[child]]
    arcs = sorted((n * 256 + b, c) for n, own in enumerate(children) for b, c in own.items())
    root = np.zeros(256, dtype=np.int32)
    for byte, child in children[0].items():
        root[byte] = child
    least = min((model.get_score(i) for i in plain), default=0.0)
    whole = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
             else b"" if model.is_control(i) else model.id_to_piece(i).encode()
             for i in range(size)]
    first = next((i for i in range(size) if model.is_byte(i)), -1)
    return Automaton(np.array([k for k, _ in arcs], dtype=np.int64),
                     np.array([c for _, c in arcs], dtype=np.int32), root,
                     np.array(fail, dtype=np.int32), np.array(link, dtype=np.int32),
                     np.array(piece, dtype=np.int32), np.array(length, dtype=np.int32),
                     np.array(score), least - UNKNOWN_PENALTY, first, whole,
                     not any(f"{MARK}" in model.id_to_piece(i).lstrip(MARK) for i in plain))


def best_paths(auto: Automaton, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of each column of `raw` (position, unit), and their numbers."""
    steps, n = raw.shape
    every = np.arange(n)
    best = np.full((steps + 1, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((steps + 1, n), dtype=np.int32)
    size = np.ones((steps + 1, n), dtype=np.int32)
    state = np.zeros(n, dtype=np.int32)
    opened = np.zeros(n, dtype=np.int64)
    for t in range(steps):
        byte = raw[t]
        opened = np.where((byte & 0xC0) != 0x80, t, opened)
        state = auto.step(state, byte)
        single = np.zeros(n, dtype=bool)
        cols = every
        node = np.where(auto.piece[state] >= 0, state, auto.link[state])
        cols, node = cols[node > 0], node[node > 0]
        while len(cols):
            long = auto.length[node]
            start = t + 1 - long
            candidate = best[start, cols] + auto.score[node]
            better = candidate > best[t + 1, cols]
            won = cols[better]
            best[t + 1, won] = candidate[better]
            back[t + 1, won] = auto.piece[node[better]]
            size[t + 1, won] = long[better]
            single[cols[start == opened[cols]]] = True
            node = auto.link[node]
            cols, node = cols[node > 0], node[node > 0]
        ends = np.ones(n, dtype=bool) if t + 1 == steps else (raw[t + 1] & 0xC0) != 0x80
        lost = np.flatnonzero((ends | (lengths == t + 1)) & ~single)
        if len(lost):
            candidate = best[opened[lost], lost] + auto.unknown
            lost = lost[candidate > best[t + 1, lost]]
            best[t + 1, lost] = best[opened[lost], lost] + auto.unknown
            for k in range(4):
                at = lost[opened[lost] + k <= t]
                place = opened[at] + k
                back[place + 1, at] = auto.first_byte + raw[place, at]
                size[place + 1, at] = 1
    place, live, order = lengths.copy(), every, []
    counts = np.zeros(n, dtype=np.int64)
    while len(live):
        live = live[place[live] > 0]
        order.append((live, back[place[live], live]))
        counts[live] += 1
        place[live] -= size[place[live], live]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if n else 0, dtype=np.int32)
    for k, (cols, found) in enumerate(order):
        ids[ends[cols] - 1 - k] = found
    return ids, counts


def best_path(auto: Automaton, raw: bytes) -> list[int]:
    """Ids of the best path of one unit, position by position."""
    arcs, root, fail, link, piece, length, score = auto.plain
    n, state, opened, low = len(raw), 0, 0, -float("inf")
    best, back, size = [0.0] + [low] * n, [0] * (n + 1), [1] * (n + 1)
    for t, byte in enumerate(raw):
        if byte & 0xC0 != 0x80:
            opened = t
        while state and state * 256 + byte not in arcs:
            state = fail[state]
        state = arcs[state * 256 + byte] if state else root[byte]
        node = state if piece[state] >= 0 else link[state]
        single, top = False, low
        while node > 0:
            start = t + 1 - length[node]
            paid = best[start] + score[node]
            if paid > top:
                top, back[t + 1], size[t + 1] = paid, piece[node], length[node]
            single = single or start == opened
            node = link[node]
        best[t + 1] = top
        if not single and (t + 1 == n or raw[t + 1] & 0xC0 != 0x80):
            paid = best[opened] + auto.unknown
            if paid > top:
                best[t + 1] = paid
                for place in range(opened, t + 1):
                    back[place + 1], size[place + 1] = auto.first_byte + raw[place], 1
    ids = []
    while n:
        ids.append(back[n])
        n -= size[n]
    return ids[::-1]


def encode_units(auto: Automaton, units: list[str]) -> pa.ListArray:
    """The ids of each unit; units of like length are read together."""
    raw = [u.encode() for u in units]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    order = np.argsort(lengths, kind="stable")
    found, counts = [], np.zeros(len(raw), dtype=np.int64)
    start = 0
    while start < len(order):
        end = start + 1
        least = int(lengths[order[start]])
        if least > LONG:
            ids = np.array(best_path(auto, raw[order[start]]), dtype=np.int32)
            found.append(ids)
            counts[order[start]] = len(ids)
            start = end
            continue
        while (end < len(order) and lengths[order[end]] <= least + least // 4 + 2
               and (end + 1 - start) * lengths[order[end]] <= CELLS):
            end += 1
        group = order[start:end]
        steps = int(lengths[group[-1]])
        table = np.zeros((len(group), steps), dtype=np.uint8)
        flat = np.frombuffer(b"".join(raw[i] for i in group), dtype=np.uint8)
        table[np.arange(steps) < lengths[group][:, None]] = flat
        ids, counts[group] = best_paths(auto, np.ascontiguousarray(table.T), lengths[group])
        found.append(ids)
        start = end
    by_length = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts[order])]).astype(np.int32)),
        pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int32)))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return by_length.take(pa.array(place))


def encode_texts(auto: Automaton, texts: list[str]) -> pa.ListArray:
    units: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        marked = MARK + text.replace(" ", MARK)
        own = [] if not text else UNIT.findall(marked) if auto.splits else [marked]
        counts[i] = len(own)
        units += own
    different, places = distinct(units, pa.large_string())
    taken = encode_units(auto, different).take(pa.array(places))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(
        pa.array(taken.offsets.to_numpy()[ends].astype(np.int32) - taken.offsets[0].as_py()),
        taken.flatten())


def decode_ids(auto: Automaton, ids: np.ndarray) -> str:
    """The text of ids; the mark is a blank, and the first one goes."""
    whole = b"".join([auto.pieces[i] for i in ids.tolist()])
    text = whole.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text",
           path: str | None = None) -> DataFrame:
    """Per document: its id, the ids of its pieces, and their number."""
    ship(docs.sparkSession)
    path = path or vocabulary(MODEL)
    kind = docs.schema[id].dataType.simpleString()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for part, texts in slices(batches, most=SLICE_BYTES):
            ids = encode_texts(auto, texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), ids, pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))],
                names=[id, "tokens", "n_tokens"])

    return docs.select(id, docs[text].cast("string").alias("text")).mapInArrow(
        run, f"`{id}` {kind}, tokens array<int>, n_tokens long")


def decode(coded: DataFrame, tokens: str = "tokens", path: str | None = None) -> DataFrame:
    """The columns given, with `decoded`, the text of the ids; null ids give a null text."""
    ship(coded.sparkSession)
    path = path or vocabulary(MODEL)
    table = coded.drop("decoded")
    schema = table.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(tokens))
            texts = [None if not x.is_valid else decode_ids(auto, x.values.to_numpy())
                     for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "decoded"])

    return table.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and an MD5 of what they decode to, to hold against the text's."""
    coded = decode(encode(read(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", "tokens", F.md5("decoded").alias("decoded_md5"))

"""Token counts as the library of the vocabulary gives them, by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets, and two neighbours are spliced at a
boundary inside their overlap that is proven stable: a single blank between two characters
that aren't white space. The pre-tokenizer never matches across it, whatever stands before or
after, so both chunks must break there and agree next to it. Without such a place the
overlap is widened, at last to the rest of the text. Smaller texts fall apart at the same kind
of boundary into units, and the library encodes each different unit of a slice once.

Defined results. Null and empty texts have no tokens; special strings in a text are tokens as
the library does by default; repeated rows repeat their result; empty tables give empty ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardline.llm.batches import distinct, slices, sums
from wardline.llm.common import read, ship

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 32_768
OVERLAP = 512
LIMIT = 512
STABLE = re.compile(r"(?<=\S) (?=\S)")


@cache
def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_window(encoder, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a part of a text, and where in the whole text each token starts."""
    code = encoder.encode(text[start:end], add_special_tokens=False)
    starts = np.fromiter((a for a, _ in code.offsets), dtype=np.int64, count=len(code.ids))
    return np.asarray(code.ids, dtype=np.int64), starts + start


def splice_at(text: str, left, right, low: int, high: int) -> tuple[int, int, int] | None:
    """A stable boundary in the overlap: its place, and the tokens before it on both sides.

    Offsets leave out the blank that opens a token, so a token at the boundary starts at
    the blank or after it. The token that follows must be the same on both sides.
    """
    middle = (low + high) // 2
    places = sorted((m.start() for m in STABLE.finditer(text, low, high)),
                    key=lambda p: abs(p - middle))
    for p in places:
        i, j = np.searchsorted(left[1], p), np.searchsorted(right[1], p)
        if (i < len(left[0]) and j < len(right[0]) and left[0][i] == right[0][j]
                and left[1][i] == right[1][j] <= p + 1):
            return p, int(i), int(j)
    return None


def huge_ids(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a text of any length, chunk by chunk."""
    kept: list[np.ndarray] = []
    end = min(len(text), chunk)
    left, skip = encode_window(encoder, text, 0, end), 0
    while end < len(text):
        wide, found = overlap, None
        while found is None:
            # Widen to both sides: where one chunk ends and where the next one starts.
            start, last = max(0, end - wide), min(len(text), end + wide + chunk)
            if wide > overlap:
                stop = min(len(text), end + wide)
                left = encode_window(encoder, text, at if kept else 0, stop)
                skip = 0
                if stop == len(text):
                    break
            else:
                stop = end
            right = encode_window(encoder, text, start, last)
            found = splice_at(text, left, right, start + 1, stop - 1)
            wide *= 2
        if found is None:
            kept.append(left[0][skip:])
            return np.concatenate(kept)
        at, i, j = found
        kept.append(left[0][skip:i])
        left, skip, end = right, j, last
    kept.append(left[0][skip:])
    return np.concatenate(kept)


def unit_counts(encoder, texts: list[str]) -> np.ndarray:
    """Token counts of texts, encoding each different unit between stable boundaries once."""
    heads: list[str] = []
    rest: list[str] = []
    sizes = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        head, *tail = STABLE.split(text)
        heads.append(head)
        rest += tail
        sizes[i] = len(tail)
    units, places = distinct(rest, pa.large_string())
    codes = encoder.encode_batch_fast(heads + [" " + u for u in units],
                                      add_special_tokens=False)
    lengths = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    return lengths[:len(heads)] + sums(lengths[len(heads):][places], sizes)


def counts(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    encoder = tokenizer(path)
    result = np.zeros(len(texts), dtype=np.int64)
    small = [i for i, t in enumerate(texts) if len(t) <= chunk]
    if small:
        result[small] = unit_counts(encoder, [texts[i] for i in small])
    for i, text in enumerate(texts):
        if len(text) > chunk:
            result[i] = len(huge_ids(encoder, text, chunk, overlap))
    return result


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Per document: its id, UTF-8 bytes, tokens, and whether it has more than `limit`."""
    ship(docs.sparkSession)
    path = path or vocabulary(VOCABULARY)
    kind = docs.schema[id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            n = counts(texts, path, chunk, overlap)
            size = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=[id, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id, docs[text].cast("string").alias("text")).mapInArrow(
        count, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))

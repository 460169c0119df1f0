"""Texts inside Python tasks: slices of bounded size, words as numbers, ragged sums."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str = "text",
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that the texts of a slice hold about `most` bytes; nulls are empty.

    A text is never cut; a longer one is a slice of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)
                           .to_numpy(zero_copy_only=False), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += int(n)
        if start < len(sizes):
            yield batch.slice(start), [x or "" for x in column.slice(start).to_pylist()]


def giving_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable:
    """A task's function that hands freed memory back to the system at its end.

    Workers are used again by later tasks of all kinds, and else hold the most of each kind.
    """
    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped


def distinct(items: list, kind: pa.DataType) -> tuple[list, np.ndarray]:
    """The different items, and the place among them of each item."""
    coded = pa.array(items, kind).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of the given lengths; empty runs give 0."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


def hashes(items: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in items), dtype=np.uint64)


def word_lists(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts with A-Z in lower case, and how many each text has.

    Words of bytes end exactly at the blank and the characters 9 to 13.
    """
    found: list[bytes] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").lower().split()
        counts[i] = len(own)
        found += own
    return found, counts

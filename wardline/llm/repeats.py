"""Removal of byte strings that occur more than once, from a Burrows-Wheeler transform.

A window is `size` bytes of a text. Every window has a mark: the smallest hash of the grams inside
it. A part is a run of windows whose mark stands at one place, so that equal windows lie in
different parts of equal mark. Marks are counted first; windows of marks that occur once are unique.
Parts that are equal byte by byte form a class, which is searched once.

The different classes of a mark meet in one block of bounded size. There the suffixes are sorted
as far as `size` bytes, and common prefixes of neighbours are derived from the transform by
increasing value: a queue holds the intervals of all strings of one length whose left border is
new, each is extended backward by every byte that precedes it, and what starts at a border
without a value gets this length as its value. Expansion stops at `size`: borders still
without a value have a common prefix of at least `size` bytes, so both neighbours repeat.

A mark whose classes exceed a block is not cut off: its classes are dealt again by marks of longer
grams, at last of whole windows, where equal marks are equal windows and classes are few.

Defined results. Texts are their UTF-8 bytes, null is empty; texts shorter than a window
stay; a repeated row repeats its text and loses all of it; ties do not matter. Very long texts are
read in stretches. Further columns are not carried, whatever their names. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import freed, read, ship, stored

SIZE = 200
#: Lengths of the grams whose hashes make marks: first for all texts, then for crowded marks.
GRAMS = (64, 150, SIZE)
BLOCK = 1_000_000
STRETCH = 1 << 19
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
KEY = ["a", "b"]


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2 to the 64."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` bytes, from sums of bytes times powers."""
    n = len(data)
    up, down = powers(STRETCH + SIZE if n <= STRETCH + SIZE else n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    found = (total[gram:] - total[:-gram]) * down[:n - gram + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(MIX)
    found ^= found >> np.uint64(29)
    return found


def window_marks(low: np.ndarray, wanted: int) -> np.ndarray:
    """The smallest of each `wanted` hashes in a row, by minima over doubling widths."""
    width = 1
    while width * 2 <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = wanted - width
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def find_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int,
               size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of the texts [start, end) that lie one after the other in `data`.

    Returns where the first window of each part starts, its number of windows, and its mark.
    """
    none = np.empty(0, np.int64)
    if len(data) < size:
        return none, none, none.astype(np.uint64)
    grams = gram_hashes(data, gram)
    marks = window_marks(grams, size - gram + 1)
    inside = np.zeros(len(marks) + 1, np.int8)
    long = ends - starts >= size
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - size + 1, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    change = np.ones(len(marks) + 1, bool)
    # A gram that leaves as the smallest ends a part, also where an equal one follows.
    change[1:-1] = ((marks[1:] != marks[:-1]) | (grams[:len(marks) - 1] == marks[:-1])
                    | (valid[1:] != valid[:-1]))
    edges = np.flatnonzero(change)
    keep = valid[edges[:-1]]
    first = edges[:-1][keep]
    return first, np.diff(edges)[keep], marks[first]


def stretches(lengths: np.ndarray, size: int = SIZE) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows and byte ranges of bounded stretches; long texts are cut, overlapping by a window."""
    rows: list[int] = []
    lows: list[int] = []
    highs: list[int] = []
    total = 0
    for row, length in enumerate(lengths.tolist()):
        if length < size:
            continue
        low = 0
        while True:
            if total >= STRETCH:
                yield np.array(rows), np.array(lows), np.array(highs)
                rows, lows, highs, total = [], [], [], 0
            high = min(length, low + STRETCH - total + size - 1)
            rows.append(row)
            lows.append(low)
            highs.append(high)
            total += high - low
            if high == length:
                break
            low = high - size + 1
    if rows:
        yield np.array(rows), np.array(lows), np.array(highs)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and where each starts; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, places


def parts_of(column: pa.Array, gram: int, size: int = SIZE) -> Iterator[tuple]:
    """Per stretch of a column: its bytes, and row, place in the stretch, place in the text,
    windows and mark of each part."""
    data, places = bytes_of(column)
    for rows, lows, highs in stretches(np.diff(places), size):
        near = np.concatenate([data[places[r] + a:places[r] + b]
                               for r, a, b in zip(rows, lows, highs)])
        ends = np.cumsum(highs - lows)
        starts = ends - (highs - lows)
        first, counts, marks = find_parts(near, starts, ends, gram, size)
        own = np.searchsorted(ends, first, side="right")
        yield near, rows[own], first, first - starts[own] + lows[own], counts, marks


def count_marks(texts: DataFrame, gram: int, size: int) -> DataFrame:
    """How many parts have each mark, copies of a text included."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for _, rows, _, _, _, marks in parts_of(batch.column(0), gram, size):
                different, place = np.unique(marks, return_inverse=True)
                n = np.bincount(place, copies[rows], len(different)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(different.view(np.int64)), pa.array(n)], names=["mark", "n"])

    found = texts.select("text", "n").mapInArrow(count, "mark long, n long")
    return found.groupBy("mark").agg(F.sum("n").alias("n"))


def list_parts(texts: DataFrame, gram: int, size: int) -> DataFrame:
    """Every part: its mark, a hash of its bytes, its text's key and copies, place and windows."""
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            for near, rows, at, start, counts, marks in parts_of(batch.column(3), gram, size):
                view = memoryview(near)
                own = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(
                    at.tolist(), (at + counts + size - 1).tolist())), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks.view(np.int64)), pa.array(own.view(np.int64)),
                     *[pa.array(k[rows]) for k in keys],
                     pa.array(start), pa.array(counts.astype(np.int32))],
                    names=["mark", "own", "a", "b", "n", "start", "windows"])

    return texts.select(*KEY, "n", "text").mapInArrow(
        find, "mark long, own long, a long, b long, n long, start long, windows int")


def sorted_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and the steps of equal keys along it."""
    n = len(key)
    own = n.bit_length()
    if bits + own < 64:  # sorting numbers that end in their place beats an argsort
        packed = np.sort((key << own) | np.arange(n))
        order, ordered = packed & ((1 << own) - 1), packed >> own
    else:
        order = np.argsort(key)
        ordered = key[order]
    return order, np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def bounded_suffixes(data: np.ndarray, size: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first `size` symbols of at most nine bits."""
    n, depth = len(data), 4
    padded = np.concatenate([data, np.zeros(depth, data.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key = (key << 9) | padded[i:i + n]
    order, steps = sorted_order(key, 9 * depth)
    while depth < size and steps[-1] < n:
        rank = np.zeros(n + depth, np.int64)
        rank[order] = steps
        step, bits = min(depth, size - depth), int(steps[-1]).bit_length()
        order, steps = sorted_order((rank[:n] << bits) | rank[step:step + n], 2 * bits)
        depth += step
    return order


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts` and hold `counts` numbers."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=starts.dtype) + np.repeat(
        (starts - ends + counts).astype(starts.dtype), counts)


def repeating_places(data: np.ndarray, size: int) -> np.ndarray:
    """Which places begin `size` symbols that also begin elsewhere, by interval expansion."""
    n = len(data)
    order = bounded_suffixes(data, size)
    before = data[order - 1]
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)
    back[by_symbol] = np.arange(n, dtype=np.int32)
    sorted_symbols = before[by_symbol]
    opens = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
    # The occurrence of a symbol before and after each of its occurrences in the transform.
    previous, following = np.roll(by_symbol, 1), np.roll(by_symbol, -1)
    previous[opens] = -1
    following[np.roll(opens, -1)] = n
    previous, following = previous[back], following[back]
    unset = np.ones(n, bool)
    low = np.flatnonzero(opens).astype(np.int32)
    high = np.append(low[1:], np.int32(n))
    unset[low] = False
    for _ in range(1, size):
        counts = high - low
        inside = spread(low, counts)
        first = np.sort(back[inside[previous[inside] < np.repeat(low, counts)]])
        last = np.sort(back[inside[following[inside] >= np.repeat(high, counts)]])
        new = unset[first]
        low, high = first[new], last[new] + 1
        unset[low] = False
        if not len(low):
            break
    found = np.zeros(n, bool)
    found[order[unset]] = True
    found[order[np.flatnonzero(unset) - 1]] = True
    return found


def repeating_runs(texts: list[bytes], copies: list[int], size: int) -> list[list[int]]:
    """Per text the borders of its runs of windows that repeat in these texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    data[ends - 1] = 0
    found = repeating_places(data, size)
    for i in np.flatnonzero(np.asarray(copies) > 1):
        found[starts[i]:ends[i]] = True
    for back in range(1, size + 1):  # windows that would leave their text
        found[np.maximum(ends - back, starts)] = False
    flags = found.astype(np.int8)
    borders = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
    cuts = np.searchsorted(borders, ends)
    return [(borders[i:j] - s).tolist()
            for i, j, s in zip(np.concatenate([[0], cuts[:-1]]), cuts, starts)]


RUNS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("runs", pa.list_(pa.int64()))])


def search_classes(classes: DataFrame, size: int, block: int) -> DataFrame:
    """Repeating runs of classes (mark, own, n, text); marks share a block as far as they fit."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def settle() -> pa.RecordBatch:
            runs = repeating_runs([x[3] for x in held], [x[2] for x in held], size)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.int64()),
                 pa.array([x[1] for x in held], pa.int64()), pa.array(runs, RUNS[2].type)],
                schema=RUNS)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:2] == held[-1][:2]:
                    continue  # a repeated row of the table brought the class along again
                if total >= block and row[0] != held[-1][0]:
                    yield settle()
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield settle()

    dealt = classes.select("mark", "own", "n", "text").repartition("mark")
    return dealt.sortWithinPartitions("mark", "own").mapInArrow(
        search, "a long, b long, runs array<long>")


def packed(texts: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text as `zip`, compressed for the shuffle that follows."""
    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = bytes_of(batch.column(batch.num_columns - 1))
            zips = [zipped(data[i:j]) for i, j in zip(places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(zips, pa.binary())], names=[*columns, "zip"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in columns)
    return texts.select(*columns, "text").mapInArrow(squeeze, f"{kinds}, zip binary")


def zipped(data: np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unzipped(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)


def take_classes(texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The bytes of each class, cut from the text that is named for it."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                marks, own, n, crowded, start, windows = wanted.values.flatten()
                data, low = unzipped(text.as_py()), start.to_numpy()
                high = low + windows.to_numpy() + size - 1
                cuts = [data[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [marks, own, n, crowded, pa.array(cuts, pa.binary())],
                    names=["mark", "own", "n", "crowded", "text"])

    wanted = classes.groupBy("at.a", "at.b").agg(F.collect_list(F.struct(
        "mark", "own", "n", "crowded", "at.start", "at.windows")).alias("wanted"))
    return packed(texts, *KEY).join(wanted, KEY).select("zip", "wanted").mapInArrow(
        cut, "mark long, own long, n long, crowded boolean, text binary")


def repeating(texts: DataFrame, size: int = SIZE, grams: tuple[int, ...] = GRAMS,
              block: int = BLOCK) -> DataFrame:
    """Runs of windows that occur again: a, b, runs (borders in the text, in pairs).

    `texts` has the key a, b of a text, its number n of copies, and text; keys may repeat. Whole
    texts are shuffled once, for the bytes of all classes. The result is stored; each step before
    is deleted, and its shuffles dropped, once the next ones stand.
    """
    spark = texts.sparkSession
    gram, *longer = grams
    marks = stored(count_marks(texts, gram, size).where("n > 1").select("mark"))
    parts = stored(list_parts(texts, gram, size).join(marks, "mark"))
    freed(spark, marks)
    classes = stored(parts.groupBy("mark", "own").agg(
        F.sum("n").alias("n"), F.min(F.struct(*KEY, "start", "windows")).alias("at")))
    totals = stored(classes.groupBy("mark").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.col("at.windows") + size).alias("bytes")
        ).select("mark", "members", ((F.col("members") > 1) & (F.col("bytes") > block)
                                     & F.lit(bool(longer))).alias("crowded")))
    known = classes.join(totals, "mark")
    cut = stored(take_classes(texts, known.where("members > 1"), size))
    freed(spark)
    # A class alone with its mark: its copies repeat as a whole, nothing else can meet it.
    alone = known.where("members = 1").select(
        F.col("mark").alias("a"), F.col("own").alias("b"),
        F.array(F.lit(0).cast("long"), F.col("at.windows").cast("long")).alias("runs"))
    found = [stored(alone.union(search_classes(cut.where("not crowded"), size, block)))]
    over = [classes, cut]
    if not totals.where("crowded").isEmpty():
        again = stored(cut.where("crowded").dropDuplicates(["mark", "own"]).select(
            F.col("mark").alias("a"), F.col("own").alias("b"), "n", "text"))
        freed(spark, *over)
        found.append(repeating(again, size, tuple(longer), block))
        over = [again]
    freed(spark, totals, *over)
    runs = reduce(DataFrame.union, found).select(
        F.col("a").alias("mark"), F.col("b").alias("own"), "runs")
    result = stored(parts.select("mark", "own", *KEY, "start").join(runs, ["mark", "own"]).where(
        F.size("runs") > 0).select(
        *KEY, F.transform("runs", lambda x: x + F.col("start")).alias("runs")))
    freed(spark, parts, *found)
    return result


def covered(runs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes covered by the windows of all runs, merged."""
    if not len(runs):
        return runs, runs
    low, high = runs[0::2], runs[1::2] + size - 1
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    opens = np.concatenate([[True], low[1:] > high[:-1]])
    return low[opens], high[np.concatenate([opens[1:], [True]])]


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE,
           grams: tuple[int, ...] = GRAMS, block: int = BLOCK) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, spans (starts and ends), kept (bytes)."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("a"),
                       F.xxhash64("text", "id", F.lit(1)).alias("b"), "text")
    runs = repeating(rows.select(*KEY, F.lit(1).cast("long").alias("n"), "text"),
                     size, grams, block)
    spans = runs.groupBy(*KEY).agg(F.flatten(F.collect_set("runs")).alias("runs"))
    kind = docs.schema[id].dataType.simpleString()

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                whole = unzipped(text.as_py())
                low, high = covered(runs.values.to_numpy(), size)
                sizes.append((len(whole), int((high - low).sum()), len(low)))
                spans.append(np.stack([low, high], 1).ravel())
                kept.append(b"".join(whole[x:y].tobytes() for x, y in zip(
                    [0, *high.tolist()], [*low.tolist(), len(whole)])))
            counts = np.array(sizes, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(spans, pa.list_(pa.int64())),
                 pa.array(kept, pa.binary())],
                names=[id, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    whole = packed(rows, "id", *KEY).join(spans, KEY, "left").select("id", "zip", F.coalesce(
        "runs", F.array().cast("array<long>")).alias("runs"))
    return whole.mapInArrow(strip, f"`{id}` {kind}, n_bytes long, n_removed long, n_spans long, "
                                   "spans array<long>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

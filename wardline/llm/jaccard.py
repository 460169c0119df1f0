"""N-gram Jaccard join: groups of texts whose shingle sets are alike, by a count-vector R-tree.

Texts with equal sets of shingles are one class. Classes that may link are brought together by
an exact rule: the shingles of a class are hashed into more groups than two linked sets can
have differences, so that linked classes agree on whole groups. How many they agree on at least
is known from the groups that are empty, so a class that shares fewer with all others together
leaves; those that stay and share a group's content form families. Keys travel once, as sorted numbers
in bundles, and only those that two classes share become rows; only texts of family rows are
sent. In a family each set is a point, the number of its shingles in each of 64 hash groups; an R-tree over the points bounds the overlap of two boxes by
the sum of the smaller coordinates, and pairs that survive are verified on the sets.

A pair is left out only where both sides are in one component already. Families with much text are
cut into blocks that share their first class; what is left apart then meets block by block.

Defined results. Null and empty texts and texts without words have an empty set and stay alone; a
text with fewer words than a shingle is one shingle. Rows with equal texts are linked, also
repeated rows. `component_id` is the smallest id reachable and null only if all are null.
Sets are compared by 64-bit hashes. Other columns are not carried; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.batches import distinct, giving_back, hashes, slices, word_lists
from wardline.llm.common import fits, freed, read, ship, stored
from wardline.llm.graphs import components
from wardline.llm.packing import pack, unpack
from wardline.llm.repeats import bytes_of, unzipped, zipped

SIZE = 3
SHARE = 90
LEVEL_RATIO = 1.5
AXES = 64
LEAF = 16
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
#: Bits of the filter of family rows that all tasks get, whatever the number of rows: 4 MB.
FILTER_BITS = 1 << 25
#: Bits of a signature that are compared before sets are; more in common only adds candidates.
KEY_BITS = 48
#: Signatures that a task holds at a time.
HELD = 1 << 20
BUNDLE = ["number", "steps", "own", "nodes", "needs"]
#: Times that classes with too few shared keys leave before families are formed.
ROUNDS = 2

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    found, counts = word_lists(texts)
    words, places = distinct(found, pa.large_binary())
    code = hashes(words)[places]
    ends = np.cumsum(counts)
    whole = np.zeros(max(len(code) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        whole = mixed(whole + code[k:k + len(whole)]) if len(whole) else whole
    result = []
    for end, n in zip(ends, counts):
        if n >= size:
            result.append(np.unique(whole[end - n:end - size + 1]))
        elif n:
            short = np.uint64(n)
            for w in code[end - n:end]:
                short = mixed(np.array([short + w], dtype=np.uint64))[0]
            result.append(np.array([short], dtype=np.uint64))
        else:
            result.append(np.zeros(0, dtype=np.uint64))
    return result


def level_of(n: int) -> tuple[int, int]:
    """The level of a size, and the largest size of the level."""
    level, low = 0, 1
    while True:
        high = max(low + 1, int(low * LEVEL_RATIO))
        if n < high:
            return level, high - 1
        level, low = level + 1, high


def signatures(shingles: np.ndarray, share: int = SHARE) -> list[tuple[np.ndarray, int]]:
    """Per level hashes of the contents of groups, and how many linked sets have in common.

    Sets of sizes a <= b that link differ in at most a * (100 - share) / share shingles, and b is
    at most a * 100 / share. The level of the smaller one sets the number of groups, so a set
    also speaks at the level of the smallest partner it may have. Empty groups say nothing
    and are left out while enough others remain to prove that a group in common has content.
    Linked sets agree on all groups but those with a difference, and of the groups they agree on
    no more can be empty than are empty in this set.
    """
    n = len(shingles)
    result: list[tuple[np.ndarray, int]] = []
    least = -(-n * share // 100)
    for level, high in dict.fromkeys((level_of(n), level_of(max(least, 1)))):
        apart = high * (100 - share) // share
        groups = apart + 1 + (apart * 3 // 20 + 2 if apart else 0)
        group = (mixed(shingles + M2) % np.uint64(groups)).astype(np.int64)
        total = np.zeros(groups, dtype=np.uint64)
        np.add.at(total, group, mixed(shingles ^ M1))
        number = np.arange(groups, dtype=np.uint64)
        keys = mixed(total + mixed(number + mixed(np.full(groups, level, dtype=np.uint64))))
        full = np.bincount(group, minlength=groups) > 0
        need = groups - apart - int((~full).sum())
        result.append((keys[full] if need > 0 else keys, max(need, 1)))
    return result


def class_of(shingles: np.ndarray) -> int | None:
    """The class of a set, a signed 64-bit hash of it."""
    if not len(shingles):
        return None
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size with two bits for each key; it may let others pass."""
    slots = keys.select(F.explode(F.array(
        F.col("key").bitwiseAND(bits - 1),
        F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(
        F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    found = np.zeros(bits >> 6, np.int64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy()
    return found.view(np.uint64)


def passes(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether keys may be in a filter."""
    last, one = np.uint64((len(words) << 6) - 1), np.uint64(1)
    hit = np.ones(len(keys), bool)
    for slot in (keys & last, (keys >> np.uint64(32)) & last):
        hit &= ((words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & one) == one
    return hit


def tabled(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """Per row: id, a hash of the row, the size of its set and its class."""
    slim = docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("row"),
                       F.col(text).cast("string").alias("text"))
    ship(docs.sparkSession)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, most=SLICE_BYTES):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_of(s) for s in sets], pa.int64())],
                names=["id", "row", "n", "node"])

    return slim.mapInArrow(
        run, f"id {slim.schema['id'].dataType.simpleString()}, row long, n long, node long")


def bundle(keys: np.ndarray, who: np.ndarray, nodes: np.ndarray, needs: np.ndarray,
           width: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Keys of a task in bundles of close ones: steps between sorted keys, whose they are, their need.

    `who` gives a key's place in `nodes` and `needs`; a bundle has the keys of `width` numbers.
    """
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    number = (keys // np.uint64(width)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(number)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        names, own = np.unique(who[low:high], return_inverse=True)
        first = int(number[low])
        steps = np.diff(keys[low:high], prepend=np.uint64(first * width))
        yield first, pack(steps), pack(own), pack(nodes[names].view(np.uint64)), pack(needs[names])


def unbundled(number: int, steps: bytes, own: bytes, nodes: bytes, needs: bytes,
              width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a bundle, and the class and need of each."""
    who = unpack(own)
    keys = np.cumsum(unpack(steps), dtype=np.uint64) + np.uint64(number * width)
    return (keys.view(np.int64), unpack(nodes).astype(np.uint64).view(np.int64)[who],
            unpack(needs).astype(np.int64)[who])


def met(keys: np.ndarray, nodes: np.ndarray,
        needs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries with some keys those, once each, whose key two classes have."""
    order = np.argsort(keys)
    alike = np.diff(keys[order]) == 0
    order = order[np.append(alike, False) | np.append(False, alike)]
    order = order[np.lexsort((needs[order], nodes[order], keys[order]))]
    keys, nodes, needs = keys[order], nodes[order], needs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (np.diff(keys) != 0) | (np.diff(nodes) != 0) | (np.diff(needs) != 0)
    keys, nodes, needs = keys[fresh], nodes[fresh], needs[fresh]
    starts = np.flatnonzero(np.append(True, np.diff(keys) != 0)[:len(keys)])
    counts = np.diff(starts, append=len(keys))
    # Nodes are sorted within a key.
    both = np.repeat(nodes[starts] != nodes[starts + counts - 1], counts)
    return keys[both], nodes[both], needs[both]


def shared_entries(docs: DataFrame, text: str, size: int, share: int, bundles: int) -> DataFrame:
    """`node`, `key` and `need` of all keys that two classes share.

    Most keys have one class only, so they travel as sorted numbers in bundles, not as rows. A
    task reads one bundle number at a time, that is one part in `bundles` of all keys.
    """
    width = -(-(1 << KEY_BITS) // bundles)
    ship(docs.sparkSession)

    @giving_back
    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        keys, nodes, needs, total = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if keys:
                who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                made = bundle(np.concatenate(keys), who, np.array(nodes, np.int64),
                              np.array(needs, np.int64), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(
                        zip(*made), [pa.int64(), *[pa.binary()] * 4])], names=BUNDLE)

        for _, texts in slices(batches, most=SLICE_BYTES):
            for shingles in shingle_sets(texts, size):
                node = class_of(shingles)
                if node is None or node in seen:
                    continue
                seen[node] = None
                for found, need in signatures(shingles, share):
                    keys.append(found >> np.uint64(64 - KEY_BITS))
                    nodes.append(node)
                    needs.append(need)
                    total += len(found)
                if total >= HELD:
                    yield from close()
                    keys, nodes, needs, total = [], [], [], 0
                    seen.clear()
        yield from close()

    @giving_back
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if parts:
                keys, nodes, needs = met(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(keys), pa.array(needs)],
                    names=["node", "key", "need"])

        for batch in batches:
            for own, *data in zip(*(batch.column(i).to_pylist() for i in range(len(BUNDLE)))):
                if own != number:
                    yield from close()
                    number, parts = own, []
                parts.append(unbundled(own, *data, width))
        yield from close()

    slim = docs.select(F.col(text).cast("string").alias("text"))
    sent = slim.mapInArrow(speak, "number long, steps binary, own binary, nodes binary, "
                                  "needs binary")
    return sent.repartition("number").sortWithinPartitions("number").mapInArrow(
        meet, "node long, key long, need long")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Keys that two classes share, and the least class `a` of each."""
    return keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(
        "a <> b").select("key", "a")


def candidates(keyed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Pairs a, b that join all classes with enough keys in common to link.

    `keyed` has `node`, `key` and `need` of keys that two classes share. Each round leaves out
    classes that share fewer keys than they need with all that are left. The stored table
    `keyed` is deleted, as is what each round leaves behind.
    """
    spark = keyed.sparkSession
    for turn in range(rounds):
        if turn:
            both = stored(keyed.join(shared_keys(keyed).select("key"), "key"))
            freed(spark, keyed)
            keyed = both
        enough = keyed.groupBy("node", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need")
        left = stored(keyed.join(enough, ["node", "need"], "left_semi").select(
            "node", "key", "need"))
        freed(spark, keyed)
        keyed = left
    near = stored(keyed.join(shared_keys(keyed), "key").where("a <> node").select(
        "a", F.col("node").alias("b")).distinct())
    freed(spark, keyed)
    return near


class Tree:
    """Boxes over points, LEAF children each, from points sorted by size and counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        high, low = self.points, self.sizes
        self.levels = [(high, low)]
        while len(low) > LEAF:
            starts = np.arange(0, len(low), LEAF)
            high, low = np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts)
            self.levels.append((high, low))

    def pairs(self, share: int,
              whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in `order`) whose boxes may link, near ones first.

        `whole` labels the components so far by place; pairs within one are left out.
        """
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][1]))
        yield from self.descend(top, a, b, share, whole)

    def descend(self, level: int, a: np.ndarray, b: np.ndarray, share: int,
                whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        high, low = self.levels[level]
        near = np.argsort(b - a, kind="stable")
        width = LEAF ** level
        for start in range(0, len(a), 4096):
            x, y = a[near[start:start + 4096]], b[near[start:start + 4096]]
            overlap = np.minimum(high[x], high[y]).sum(1)
            # Linked sets share at least this part of the sum of their sizes.
            hit = (100 + share) * overlap >= share * (low[x] + low[y])
            x, y = x[hit], y[hit]
            if level == 0:
                apart = whole[x] != whole[y]
                yield x[apart], y[apart]
                continue
            n = len(self.levels[level - 1][1])
            for i, j in zip(x.tolist(), y.tolist()):
                one = whole[i * width]
                if (one == whole[j * width] and (whole[i * width:(i + 1) * width] == one).all()
                        and (whole[j * width:(j + 1) * width] == one).all()):
                    continue  # both boxes lie in one component
                left = np.arange(i * LEAF, min(n, (i + 1) * LEAF))
                right = np.arange(j * LEAF, min(n, (j + 1) * LEAF))
                p, q = np.meshgrid(left, right, indexing="ij")
                once = (p <= q).ravel() if i == j else slice(None)
                yield from self.descend(level - 1, p.ravel()[once], q.ravel()[once], share, whole)


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], share: int = SHARE,
           labels: list | None = None) -> list[tuple[int, int]]:
    """Links that join all that is linked: verified pairs, less those within a component.

    `labels` name components that are known already; equal labels need no link.
    """
    if len(sets) == 2:
        same = labels is not None and labels[0] == labels[1]
        return [(0, 1)] if not same and linked(*sets, share) else []
    points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=AXES)
                       for s in sets]).astype(np.int32)
    tree = Tree(points, np.array([len(s) for s in sets]))
    names = np.arange(len(sets)) if labels is None else np.unique(
        np.asarray(labels), return_inverse=True)[1]
    whole = names[tree.order]
    found = []
    quick = [frozenset(x.tolist()) for x in sets]
    for some, others in tree.pairs(share, whole):
        for i, j in zip(some.tolist(), others.tolist()):
            a, b = whole[i], whole[j]
            left, right = int(tree.order[i]), int(tree.order[j])
            if a == b:
                continue
            both = len(quick[left] & quick[right])
            if 100 * both >= share * (len(quick[left]) + len(quick[right]) - both):
                whole[whole == a] = b
                found.append((left, right))
    return found


def verify(members: DataFrame, group: list[str], size: int, share: int) -> DataFrame:
    """Links a, b between the members of each group (`node`, `zip`, `label` may be null)."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts, labels = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                known = None if labels[0] is None else labels
                pairs = forest(shingle_sets(texts, size), share, known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i, _ in pairs], pa.int64()),
                     pa.array([nodes[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for *own, node, data, label in zip(*[columns[g] for g in group], columns["node"],
                                               columns["zip"], columns["label"]):
                if own != key:
                    yield from close()
                    key, nodes, texts, labels = own, [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    texts.append(unzipped(data).tobytes().decode("utf-8", "surrogatepass"))
                    labels.append(label)
        yield from close()

    ship(members.sparkSession)
    dealt = members.select(*group, "node", "zip", "label").repartition(*group)
    return dealt.sortWithinPartitions(*group, "node").mapInArrow(run, "a long, b long")


def packed_rows(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """`row`, `bytes` and the compressed text `zip` of the rows that pass a filter."""
    ship(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(words)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(batch.column(0).to_numpy().view(np.uint64), sent.value)
            part = batch.filter(pa.array(hit))
            data, places = bytes_of(part.column(2))
            zips = [zipped(data[i:j]) for i, j in zip(places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(zips, pa.binary())],
                names=["row", "bytes", "zip"])

    return texts.select("row", "bytes", "text").mapInArrow(
        run, "row long, bytes int, zip binary")


def family_links(docs: DataFrame, families: DataFrame, id: str, text: str, size: int,
                 share: int, block_bytes: int) -> DataFrame:
    """All links needed within the families (`row`, `node`, `family`)."""
    texts = docs.select(F.xxhash64(id, text).alias("row"), F.octet_length(text).alias("bytes"),
                        F.col(text).cast("string").alias("text"))
    # Each class has one row; copies of that row leave where it meets its family. Most rows are in
    # no family, and their texts stay where they are.
    chosen = packed_rows(texts, key_filter(families.select(F.col("row").alias("key"))))
    members = stored(chosen.join(families, "row").dropDuplicates(["row"])
                     .select("node", "family", "bytes", "zip"))
    freed(docs.sparkSession)
    weight = members.groupBy("family").agg(
        F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("blocks"))
    # Only large families need a number of blocks; all others are one block.
    large = stored(weight.where("blocks > 1"))
    joined = members.join(F.broadcast(large) if fits(large, 100_000) else large, "family", "left")
    first = F.col("node") == F.col("family")
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(
        first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.col("node"), F.col("blocks")).cast("int")))
    dealt = joined.withColumn("block", F.explode(block)).withColumn("label", F.lit(None).cast("long"))
    links = stored(verify(dealt, ["family", "block"], size, share))
    if large.isEmpty():
        return links
    # What the blocks of a family left apart. Rows of its largest component stay in their
    # block; all others visit every block, some at a time, so that all that differ meet.
    spread = (joined.where("blocks IS NOT NULL")
              .select("node", "family", "blocks", "bytes")
              .join(components(links), "node", "left")
              .withColumn("label", F.coalesce("root", "node")).drop("root"))
    sizes = spread.groupBy("family", "label").agg(F.sum("bytes").alias("bytes"))
    rest = F.sum("bytes") - F.max("bytes")
    top = sizes.groupBy("family").agg(
        F.max_by("label", F.struct("bytes", "label")).alias("top"),
        F.ceil(rest / block_bytes).cast("int").alias("turns"), F.count(F.lit(1)).alias("parts"))
    placed = stored(spread.join(top.where("parts > 1"), "family").withColumn(
        "own", F.pmod("node", F.col("blocks")).cast("int")).withColumn(
        "turn", F.pmod(F.xxhash64("node"), F.greatest("turns", F.lit(1))).cast("int")))
    if placed.isEmpty():
        return links
    each_turn = F.sequence(F.lit(0), F.greatest("turns", F.lit(1)) - 1)
    stay = placed.select("node", "family", "label", F.col("own").alias("block"),
                         F.explode(each_turn).alias("turn"))
    visit = (placed.where("label <> top").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own")
        .select("node", "family", "label", "block", "turn"))
    met = stay.union(visit).join(members.select("node", "zip"), "node")
    more = stored(verify(met, ["family", "block", "turn"], size, share))
    freed(docs.sparkSession, members, large, placed)
    return links.union(more)


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE,
         share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of the documents: id, `row` (a hash), `n_shingles` and `component_id`."""
    spark = docs.sparkSession
    table = stored(tabled(docs, id, text, size))
    # At most so many signatures a shingle: groups at two levels, each up to LEVEL_RATIO too large.
    shingles = table.agg(F.sum("n")).first()[0] or 0
    entries = shingles * 4 * (100 - share) // share
    bundles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // HELD))
    keyed = stored(shared_entries(docs, text, size, share, bundles))
    freed(spark)
    near = candidates(keyed)
    families = components(near)
    one = table.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"))
    homes = stored(families.select("node", F.col("root").alias("family")).join(one, "node"))
    freed(spark, near, families)
    links = family_links(docs, homes, id, text, size, share, block_bytes)
    freed(spark, homes)
    roots = components(links)
    classes = table.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    rooted = classes.join(roots, "node", "left")
    known = stored(rooted.where("rows > 1 OR root IS NOT NULL").select(
        "node", F.coalesce("root", "node").alias("root"), "least"))
    freed(spark, roots)
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    names = stored(known.join(least, "root").select("node", "component"))
    freed(spark, known)
    side = F.broadcast(names) if fits(names, 100_000) else names
    return table.join(side, "node", "left").select(
        F.col("id").alias(id), "row", F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without all but one of each group: the one with the smallest id.

    Documents without words stay. Of rows that are equal in id and text one stays.
    """
    found = stored(join(docs, id, text, **options).where("n_shingles > 0"))
    freed(docs.sparkSession)
    kept = F.col(id).eqNullSafe(F.col("component_id"))
    gone = stored(found.where(~kept).select("row").distinct())
    # Equal rows among those kept, and different texts that carry the group's smallest id.
    more = found.where(kept).groupBy("component_id").agg(
        F.min("row").alias("row"), F.max("row").alias("last"), F.count(F.lit(1)).alias("n"))
    twice = stored(more.where("n > 1 AND component_id IS NOT NULL"))
    keyed = docs.withColumn("m_row", F.xxhash64(id, text))

    def among(side: DataFrame, how: str, of: DataFrame) -> DataFrame:
        side = F.broadcast(side) if fits(side, 100_000) else side
        return of.join(side, of["m_row"] == side["row"], how)

    left = among(gone, "left_anti", keyed)
    if twice.isEmpty():
        return left.drop("m_row")
    rows = stored(found.where(kept).join(twice.select("component_id"), "component_id")
                  .select("row").distinct())
    once = among(twice.select("row"), "left_semi", left).dropDuplicates(["m_row"])
    return among(rows, "left_anti", left).unionByName(once).drop("m_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).drop("row")


ORACLE = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
  FROM worded, unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) > 0),
sized AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM cut a JOIN cut b
  ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x.a, x.b FROM shared x JOIN sized p ON p.doc_id = x.a JOIN sized q ON q.doc_id = x.b
  WHERE 100 * x.n >= 90 * (p.n + q.n - x.n)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS id FROM documents
  UNION SELECT l.b, r.id FROM reach r JOIN both_ways l ON l.a = r.node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(id) AS component_id FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

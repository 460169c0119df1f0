"""The prefix trie of conversations, built as burst tries.

A turn's id is a 128-bit hash of its role and text, a conversation is its list of ids, and equal
conversations collapse to one with a count. A container holds all conversations under a top
node, as suffixes; at first there is one per first turn. A container of more than `limit` turns
bursts: its top node becomes a trie head, and its conversations are dealt to containers of the
next turn id, round after round until none is too large. Heads and containers are keyed by
a hash of their whole prefix, by which Spark deals them to shards. Each remaining container
is sorted and swept once into nodes; what it sums to is added to the heads above it.

Defined results. Rows without an id belong to no conversation and are left out; null roles and
texts are empty; turns are ordered by number (null first), role and text, and a repeated row is a
turn of its own. A conversation's ids are held in one row (16 bytes a turn), its texts never are.
The ids that end at a node are hashed in order from a sorted stream. Long texts are
hashed whole. Further columns are not carried, whatever their names. Empty tables have no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardline.llm.common import count_words, read, ship, stored
from wardline.llm.turn_repair import CRC

LIMIT = 1 << 16
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")


def sequences(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation its turns in order: conv, steps (id of the turn, words of its text)."""
    rows = turns.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    name = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    placed = rows.select("conv", F.row_number().over(order).alias("place"),
                         F.unhex(F.md5(name)).alias("id"), count_words(F.col("text")).alias("words"))
    listed = placed.groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("place", "id", "words"))).alias("steps"))
    return listed.select("conv", F.transform(
        "steps", lambda s: F.struct(s["id"].alias("id"), s["words"].alias("words"))).alias("steps"))


def rebuilt(convs: DataFrame, group: int = 20) -> DataFrame:
    """Conversations whose first turns, none to three by a hash of the id, are those of the
    conversation that opens their group of ids."""
    h = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    opening = convs.where(F.col("conv") % group == 0).select(
        F.col("conv").alias("opener"), F.slice("steps", 1, 3).alias("lead"))
    both = convs.join(opening, F.col("conv") - F.col("conv") % group == F.col("opener"), "left")
    nothing = F.array().cast(convs.schema["steps"].dataType)
    return both.select("conv", F.concat(
        F.slice(F.coalesce("lead", nothing), F.lit(1), h),
        F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))).alias("steps"))


def ends_of(convs: DataFrame) -> DataFrame:
    """Per sequence (key) the hash of the ids of its conversations in ascending order."""
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            keys = batch.column(0).to_pylist()
            convs = list(map(str, batch.column(1).to_pylist()))
            borders = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(borders, borders[1:]):
                said = ",".join(convs[a:b]).encode()
                if keys[a] == key:
                    digest.update(b"," + said)
                    continue
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = keys[a], hashlib.sha256(said)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)],
                                                 names=["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])],
                                             names=["key", "ends"])

    return convs.select("key", "conv").repartition("key").sortWithinPartitions(
        "key", "conv").mapInArrow(fold, "key binary, ends string")


def collapsed(convs: DataFrame) -> DataFrame:
    """Different sequences: steps, n conversations, the least of them, and ends."""
    ids = F.array_join(F.transform("steps", lambda s: F.hex(s["id"])), "")
    keyed = stored(convs.withColumn("key", F.unhex(F.md5(ids))))
    seqs = keyed.groupBy("key", "steps").agg(F.count(F.lit(1)).alias("n"),
                                             F.min("conv").alias("least"))
    return seqs.join(ends_of(keyed), "key").drop("key")


def below(head, step):
    """The head of the prefix that is one turn longer."""
    return F.unhex(F.md5(F.concat(head, step["id"])))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that go on below their head, dealt to containers of the next turn id."""
    step = F.col("steps")[F.col("depth")]
    return rows.where(F.size("steps") > F.col("depth")).select(
        "steps", "n", "least", "ends", (F.col("depth") + 1).alias("depth"),
        F.concat("path", F.array("head")).alias("path"), below(F.col("head"), step).alias("head"))


def burst(rows: DataFrame) -> DataFrame:
    """The nodes on top of containers that burst."""
    ends_here = F.size("steps") == F.col("depth")
    # The root has no last turn, so nothing of it is saved.
    words = F.when(F.col("depth") > 0,
                   F.col("steps")[F.greatest(F.col("depth") - 1, F.lit(0))]["words"]).otherwise(0)
    return rows.groupBy("head", "path", "depth").agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max(words).alias("words"),
        F.max(F.when(ends_here, F.col("ends"))).alias("ends"))


def sweep(rows: list[tuple], depth: int, above: int) -> list[tuple]:
    """The nodes of a container from its sorted suffixes (ids, words, n, least, ends).

    `depth` is that of the top node, `above` the least conversation of the head above.
    """
    parents: list[int] = []
    depths: list[int] = []
    words: list[int] = []
    n: list[int] = []
    least: list[int | None] = []
    ends: list[str] = []
    path: list[int] = []
    last: list[bytes] = []
    for ids, counts, copies, first, digest in rows:
        shared = 0
        while shared < len(last) and shared < len(ids) and last[shared] == ids[shared]:
            shared += 1
        del path[shared:]
        for i in range(shared, len(ids)):
            parents.append(path[-1] if path else -1)
            path.append(len(depths))
            depths.append(depth + i)
            words.append(counts[i])
            n.append(0)
            least.append(None)
            ends.append(NOBODY)
        n[path[-1]], least[path[-1]], ends[path[-1]] = copies, first, digest
        last = ids
    children = [0] * len(depths)
    leaves = [0] * len(depths)
    saved = [0] * len(depths)
    for i in range(len(depths) - 1, -1, -1):  # all nodes below i come after it
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * words[i]
        up = parents[i]
        if up >= 0:
            n[up] += n[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    return [(least[i], depths[i], above if parents[i] < 0 else least[parents[i]], n[i],
             children[i], leaves[i], saved[i], ends[i], parents[i] < 0)
            for i in range(len(depths))]


def swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers; `path` only with top nodes."""
    schema = pa.schema([(c, pa.int64()) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens")] + [("ends_sha256", pa.string()), ("path", pa.list_(pa.binary()))])

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, top, held, out = None, None, [], []

        def settle() -> None:
            depth, above, path = top
            out.extend((*x[:-1], path if x[-1] else None) for x in sweep(held, depth, above))
            held.clear()

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            steps = batch.column(1)
            offsets = steps.offsets.to_numpy()
            ids, words = steps.values.field(0).to_pylist(), steps.values.field(1).to_pylist()
            others = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)]
            for i, (own, n, least, ends, depth, above, path) in enumerate(zip(*others)):
                if own != head:
                    if held:
                        settle()
                    if len(out) >= 10_000:
                        yield emit()
                    head, top = own, (depth, above, path)
                a, b = offsets[i], offsets[i + 1]
                held.append((ids[a:b], words[a:b], n, least, ends))
        if held:
            settle()
        if out:
            yield emit()

    suffix = F.slice("steps", F.col("depth"), F.size("steps") - F.col("depth") + 1)
    sorted_ = containers.select("head", suffix.alias("steps"), "n", "least", "ends", "depth",
                                "above", "path").repartition("head").sortWithinPartitions(
        "head", "steps")
    return sorted_.mapInArrow(nodes, f"{NODE}, path array<binary>")


def build(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the trie of sequences (conv, steps)."""
    ship(convs.sparkSession)
    root = collapsed(convs).select(
        "steps", "n", "least", "ends", F.lit(0).alias("depth"),
        F.array().cast("array<binary>").alias("path"), F.lit(b"").alias("head"))
    bursting = stored(root)
    settled, heads = None, None
    while True:
        tops = stored(burst(bursting))
        heads = tops if heads is None else heads.union(tops)
        rows = stored(dealt(bursting))
        sizes = rows.groupBy("head").agg(
            F.sum(F.size("steps") - F.col("depth") + 1).alias("turns"),
            F.count(F.lit(1)).alias("members"))
        large = stored(sizes.where((F.col("turns") > limit) & (F.col("members") > 1))
                       .select("head"))
        if large.isEmpty():
            settled = rows if settled is None else settled.union(rows)
            break
        kept = rows.join(large, "head", "left_anti").select(rows.columns)
        settled = kept if settled is None else settled.union(kept)
        bursting = stored(rows.join(large, "head", "left_semi").select(rows.columns))
    above = heads.select(F.col("head").alias("_head"), F.col("conv_id").alias("above"))
    containers = settled.join(above, F.element_at("path", -1) == F.col("_head")).drop("_head")
    nodes = stored(swept(containers))
    return nodes.drop("path").union(head_nodes(heads, nodes, above))


def head_nodes(heads: DataFrame, nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Heads as nodes, with the sums of all that lies below them."""
    own = (F.col("n_convs") - 1) * F.col("words")
    tops = nodes.where(F.col("path").isNotNull())
    parts = tops.select(F.explode("path").alias("_below"), "n_leaves", "saved_tokens").union(
        heads.select(F.explode(F.concat("path", F.array("head"))), F.lit(0), own))
    sums = parts.groupBy("_below").agg(F.sum("n_leaves").alias("leaves"),
                                       F.sum("saved_tokens").alias("saved_tokens"))
    children = tops.select(F.element_at("path", -1).alias("_up")).union(
        heads.where("depth > 0").select(F.element_at("path", -1))).groupBy("_up").agg(
        F.count(F.lit(1)).alias("n_children"))
    upper = above.select(F.col("_head").alias("_parent"), F.col("above").alias("parent_conv_id"))
    found = heads.join(sums, F.col("head") == F.col("_below")).join(
        children, F.col("head") == F.col("_up"), "left").join(
        upper, F.element_at("path", F.when(F.size("path") > 0, -1)) == F.col("_parent"), "left")
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def trie(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
         text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The prefix trie of conversations as they are."""
    return build(sequences(turns, id, turn, role, text), limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return build(rebuilt(stored(sequences(turns, "conv_id", "turn", "role", "text"))))


ORACLE = f"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, CAST({CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h, count(*) AS own
  FROM ordered GROUP BY conv_id),
leads AS (
  SELECT c.conv_id, c.h, c.own, least(c.h, coalesce(b.own, 0)) AS lead
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
turns AS (
  SELECT l.conv_id, place, role, text FROM leads l
    JOIN ordered o ON o.conv_id = l.conv_id - l.conv_id % 20 AND place <= lead
  UNION ALL
  SELECT l.conv_id, place - h + lead, role, text FROM leads l
    JOIN ordered o ON o.conv_id = l.conv_id AND place > h),
prefixes AS (
  SELECT conv_id, place AS depth, text, string_agg(md5(role) || md5(text), '') OVER (
    PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS said FROM turns
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
members AS (
  SELECT p.*, depth = lead + greatest(own - h, 0) AS whole
  FROM prefixes p JOIN leads l ON l.conv_id = p.conv_id),
nodes AS (
  SELECT depth, said, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * min(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (whole), '')) AS ends_sha256
  FROM members GROUP BY depth, said),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, left(n.said, 64 * (n.depth - 1)) AS above
  FROM nodes n LEFT JOIN nodes p
    ON n.depth > 0 AND p.depth = n.depth - 1 AND p.said = left(n.said, 64 * (n.depth - 1))),
children AS (
  SELECT depth - 1 AS depth, above AS said, count(*) AS n_children
  FROM linked WHERE depth > 0 GROUP BY depth, above),
full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children
  FROM linked n LEFT JOIN children c ON c.depth = n.depth AND c.said = n.said),
spread AS (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes),
sums AS (
  SELECT up AS depth, left(said, 64 * up) AS said, sum(saved) AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves
  FROM spread GROUP BY up, left(said, 64 * up))
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.said = n.said
"""

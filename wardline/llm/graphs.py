"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import giving_back
from wardline.llm.common import freed, ship, stored

#: Rows of links that one task joins (16 bytes each); of more, rounds make fewer first.
FEW = 100_000


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a, b, and the smallest node of the component of each."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(names)))
    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # a root is never larger than its node
        root[x] = root[root[x]]
    return names, names[np.array(root, np.int64)]


@giving_back
def join_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`old` and `new` name of each node of a task's links."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in least_of(*map(np.concatenate, zip(*parts)))],
            names=["old", "new"])


def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for all nodes in links a, b.

    Each round every root that still has links moves to its smallest neighbour, and links
    are renamed and thinned. Nodes are hashes, so that the number of roots falls by a share
    in each round whatever the shape. Hot roots only meet joins that adaptive execution splits.
    Once few links are left one task joins them: rounds go on long after most links are gone, and
    the driver plans, sends and remembers as much for each. A round's tables are deleted at its
    end, and the driver drops its plans, shuffles and small broadcast tables, which it would hold
    for all rounds otherwise.
    """
    spark = links.sparkSession
    both = links.select("a", "b").where("a <> b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stored(both.distinct())
    roots = stored(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while left.count() > FEW:
        moves = stored(left.groupBy("a").agg(F.min("b").alias("near")).select(
            F.col("a").alias("old"), F.least("a", "near").alias("new")))
        over = [left, roots, moves]
        for _ in range(2):  # shortcuts: follow the move of where one moved to
            on = moves.select(F.col("old").alias("via"), F.col("new").alias("further"))
            moves = stored(moves.join(on, F.col("new") == F.col("via"), "left").select(
                "old", F.least(F.coalesce("further", "new"), F.col("new")).alias("new")))
            over.append(moves)
        roots = stored(roots.join(moves, F.col("root") == F.col("old"), "left").select(
            "node", F.coalesce("new", "root").alias("root")))
        first = left.join(moves, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        left = stored(first.join(moves, F.col("b") == F.col("old")).select(
            "a", F.col("new").alias("b")).where("a <> b").distinct())
        freed(spark, *over)
    if left.isEmpty():
        return roots
    ship(spark)
    moves = left.select("a", "b").repartition(1).mapInArrow(join_few, "old long, new long")
    ends = stored(roots.join(moves, F.col("root") == F.col("old"), "left").select(
        "node", F.coalesce("new", "root").alias("root")))
    freed(spark, left, roots)
    return ends

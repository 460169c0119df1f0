"""Approximate nearest neighbours by learned partitions.

On a sample of at most `SAMPLE` different vectors, the neighbour graph is cut into equal parts by
recursive bisection: each part is ordered by a smooth vector of its graph, halved at the
median and mended by swaps. A small classifier learns in which parts the neighbours of a vector
lie. Every vector is stored in its most probable part; a query visits parts in the order of
their probability until they sum up to a share, the smallest one with which the sample's own
queries reach `RECALL`, and hold enough vectors for `k` others. The vectors found are ranked by their cosine in double precision.

Equal vectors are searched as one, which carries its `k + 1` smallest ids; nothing else can
be among the nearest. Parts are dealt in blocks of bounded size, so a large part is many tasks.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components take no
part. A cosine needs vectors of one length, so each length has an index of its own, in which
its queries are searched; lengths are expected to be few. Rows without id take no part. Further
columns are not carried, whatever their names. Rows with the same id and vector count once. Equal scores go to the smaller id.
With fewer candidates than `k`, all are returned. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import read, ship, stored

K = 5
EVERY = 50
SAMPLE = 8192
PART_ROWS = 64
BLOCK_ROWS = 4096
RECALL = 0.96
SALTS = 64
SEED = 5


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def graph(vectors: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest others of each vector."""
    k = min(k, len(vectors) - 1)
    found = np.empty((len(vectors), k), dtype=np.int64)
    for start in range(0, len(vectors), 1024):
        near = vectors[start:start + 1024] @ vectors.T
        near[np.arange(len(near)), start + np.arange(len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        found[start:start + 1024] = np.take_along_axis(top, order, 1)
    return found


def halves(links: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which of the members go to the second half, of equal size, with few links cut."""
    n = len(members)
    place = np.full(len(links), -1)
    place[members] = np.arange(n)
    to = place[links[members]]
    a = np.repeat(np.arange(n), to.shape[1])[to.ravel() >= 0]
    b = to.ravel()[to.ravel() >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    smooth = rng.normal(size=n)
    for _ in range(60):
        smooth = smooth + np.bincount(a, smooth[b], n) / degree
        smooth -= np.average(smooth, weights=degree)
        smooth /= np.abs(smooth).max() + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(smooth, kind="stable")[n // 2:]] = True
    for _ in range(8):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - degree
        out = np.flatnonzero(~side)[np.argsort(-gain[~side], kind="stable")]
        back = np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")]
        pairs = min(len(out), len(back), max(1, n // 20))
        good = gain[out[:pairs]] + gain[back[:pairs]] > 0
        if not good.any():
            break
        side[out[:pairs][good]], side[back[:pairs][good]] = True, False
    return side


def partition(links: np.ndarray, levels: int, seed: int = SEED) -> np.ndarray:
    """A part for each vertex, 2 ** levels parts of equal size."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(links), dtype=np.int64)
    for _ in range(levels):
        halved = part * 2
        for p in range(part.max() + 1):
            members = np.flatnonzero(part == p)
            if len(members) > 1:
                halved[members] += halves(links, members, rng)
        part = halved
    return part


@dataclass
class Router:
    """Two layers that give the probability of each part; how far to go down the list."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    share: float = 1.0

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        score = np.maximum(vectors @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def visits(self, vectors: np.ndarray, share: float | None = None,
               sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """Which parts each query visits; those of `sizes` vectors hold at least `least` in all."""
        p = self.probabilities(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
        result = np.zeros(p.shape, dtype=bool)
        go = before < (self.share if share is None else share)
        if sizes is not None:
            held = sizes[order]
            go |= np.cumsum(held, 1) - held < least
        np.put_along_axis(result, order, go, 1)
        return result


def learn(vectors: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40,
          batch: int = 256, rate: float = 0.003, seed: int = SEED) -> Router:
    """A classifier for the shares of neighbours per part."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, (2 / vectors.shape[1]) ** 0.5 * 2, (vectors.shape[1], hidden)),
           np.zeros(hidden), rng.normal(0, hidden ** -0.5, (hidden, goal.shape[1])),
           np.zeros(goal.shape[1])]
    moment, square, step = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net], 0
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for start in range(0, len(order), batch):
            at = order[start:start + batch]
            x = vectors[at]
            mid = np.maximum(x @ net[0] + net[1], 0)
            off = (Router(*net).probabilities(x) - goal[at]) / len(at)
            down = (off @ net[2].T) * (mid > 0)
            step += 1
            for i, g in enumerate((x.T @ down, down.sum(0), mid.T @ off, off.sum(0))):
                moment[i] += 0.1 * (g - moment[i])
                square[i] += 0.01 * (g * g - square[i])
                net[i] = net[i] - rate * (moment[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8) - rate * 1e-3 * net[i]
    return Router(*net)


def fit(sample: np.ndarray, rows: int, k: int = K, recall: float = RECALL) -> Router:
    """The router of a sample of vectors, for an index of so many rows."""
    vectors = unit(np.asarray(sample, dtype=np.float64))
    most = max(1, len(vectors) // 32)
    parts = min(max(1, rows // PART_ROWS), most)
    levels = int(np.log2(parts)) if parts > 1 else 0
    if levels == 0:
        d = vectors.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    links = graph(vectors)
    part = partition(links, levels)
    goal = np.zeros((len(vectors), 2 ** levels))
    np.add.at(goal, (np.arange(len(vectors))[:, None], part[links]), 1.0)
    goal[np.arange(len(vectors)), part] += 1.0
    goal /= goal.sum(1, keepdims=True)
    # Half of the sample sets the share, with a router that has not seen it; all of it is fitted.
    seen = np.random.default_rng(SEED).random(len(vectors)) < 0.5
    trial = learn(vectors[seen], goal[seen])
    home = trial.probabilities(vectors).argmax(1)
    asked = vectors[~seen]
    router = learn(vectors, goal)
    near = links[~seen][:, :k]
    for share in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 1.1):
        router.share = share
        hits = np.take_along_axis(trial.visits(asked, share), home[near], 1)
        if hits.mean() >= recall:
            break
    return router


def valid(vector: Column) -> Column:
    """Whether a vector has a direction."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x) < float("inf")))
    return (vector.isNotNull() & F.coalesce(sound, F.lit(False))
            & F.exists(vector, lambda x: x != 0))


def representatives(table: DataFrame, k: int) -> DataFrame:
    """Each different vector with its smallest ids, at most k + 1 of them.

    The ids of a vector that many rows share are thinned in salted groups first.
    """
    key = F.xxhash64("v")
    keyed = table.withColumn("h", key)
    salted = Window.partitionBy("h", "v", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    first = keyed.withColumn("r", F.dense_rank().over(salted)).where(F.col("r") <= k + 1)
    first = first.drop("r").dropDuplicates(["id", "v"])
    over = Window.partitionBy("h", "v").orderBy("id")
    few = first.withColumn("r", F.row_number().over(over)).where(F.col("r") <= k + 1)
    return few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.element_at("ids", 1).alias("rep"), "ids", "v")


def search(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding",
           k: int = K, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each query row (`id`, `vector`) the k nearest other rows: query_id, rank, id, score."""
    def sound(df: DataFrame) -> DataFrame:
        return df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")
                         ).where(F.col("id").isNotNull() & valid(F.col("v")))

    ship(vectors.sparkSession)
    kind = vectors.schema[id].dataType.simpleString()
    found = vectors.sparkSession.createDataFrame(
        [], f"query_id {kind}, rank int, `{id}` {kind}, score double")
    whole, asked = sound(vectors), sound(queries)
    size = F.size("v")
    for row in whole.select(size.alias("n")).distinct().orderBy("n").collect():
        table = stored(representatives(whole.where(size == row["n"]), k))
        found = found.union(search_length(table, asked.where(size == row["n"]).dropDuplicates(
            ["id", "v"]), row["n"], id, k, sample, block_rows))
    return found


def search_length(table: DataFrame, asked: DataFrame, dims: int, id: str, k: int, sample: int,
                  block_rows: int) -> DataFrame:
    """The search among different vectors (rep, ids, v) of one length."""
    rows = table.count()
    picked = (table.orderBy(F.xxhash64("v", F.lit(SEED)), "rep").limit(sample).select("v")
              .collect())
    router = fit(np.array([r["v"] for r in picked]).reshape(len(picked), dims), rows, k)

    def route(first_only: bool, sizes: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(np.asarray(batch.column(batch.num_columns - 1).flatten())
                         .reshape(batch.num_rows, -1))
                if first_only:
                    at, part = np.arange(len(x)), router.probabilities(x).argmax(1)
                else:
                    at, part = np.nonzero(router.visits(x, sizes=sizes, least=k + 2))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at)) for c in batch.columns],
                     pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])
        return run

    kind = table.schema["rep"].dataType.simpleString()
    homes = stored(table.select("rep", "ids", "v").mapInArrow(
        route(True), f"rep {kind}, ids array<{kind}>, v array<double>, part int"))
    # At most one row for each part of the router. A query may be one of the vectors itself.
    counted = stored(homes.groupBy("part").count())
    sizes = np.zeros(router.w2.shape[1], dtype=np.int64)
    for r in counted.collect():
        sizes[r["part"]] = r["count"]
    visits = stored(asked.select("id", "v").mapInArrow(
        route(False, sizes), f"id {kind}, v array<double>, part int"))
    # Numbers of blocks per part.
    n_homes = counted.withColumn(
        "c_blocks", F.ceil(F.col("count") / block_rows).cast("int")).select("part", "c_blocks")
    n_visits = visits.groupBy("part").count().withColumn(
        "q_blocks", F.ceil(F.col("count") / block_rows).cast("int")).select("part", "q_blocks")
    blocks = F.broadcast(stored(n_homes.join(n_visits, "part")))
    left = (homes.join(blocks, "part")
            .withColumn("c", F.pmod(F.xxhash64("rep"), F.col("c_blocks")).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
            .select("part", "c", "q", F.col("rep").alias("id"), "v", F.lit(False).alias("asks")))
    right = (visits.join(blocks, "part")
             .withColumn("q", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int"))
             .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
             .select("part", "c", "q", "id", "v", F.lit(True).alias("asks")))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        result = {"query_id": [], "rep": [], "score": []}
        if asks.any() and not asks.all():
            x = np.stack(group["v"].to_numpy())
            norms = np.sqrt((x * x).sum(1))
            ids = group["id"].to_numpy()
            # Sorted, so that the stable order below takes the smaller id first.
            there = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]
            here = np.flatnonzero(asks)
            most = min(k + 1, len(there))
            for start in range(0, len(here), 512):
                q = here[start:start + 512]
                near = (x[q] @ x[there].T) / norms[q][:, None] / norms[there]
                # All that reach the last place, since the product of matrices may round.
                edge = -np.partition(-near, most - 1, axis=1)[:, most - 1]
                a, b = np.nonzero(near >= edge[:, None] - 1e-12)
                a, b = q[a], there[b]
                result["query_id"].append(ids[a])
                result["rep"].append(ids[b])
                result["score"].append((x[a] * x[b]).sum(1) / (norms[a] * norms[b]))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0) for c, v in
                             result.items()}).astype({"query_id": group["id"].dtype,
                                                      "rep": group["id"].dtype})

    found = left.unionByName(right).groupBy("part", "c", "q").applyInPandas(
        nearest, f"query_id {kind}, rep {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    top = stored(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
                 .drop("r"))
    # The classes found are few per query; each stands for its smallest ids.
    whole = top.join(table.select("rep", "ids"), "rep").select(
        "query_id", F.explode("ids").alias(id), "score").where(F.col(id) != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return (whole.dropDuplicates(["query_id", id])
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", id, "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))

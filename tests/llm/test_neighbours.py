import numpy as np
from pyspark.sql import functions as F

from wardline.llm import neighbours as nn


def plain(rows, asked, k=nn.K):
    """Nearest others of each asked id, by comparing all."""
    rows = {i: np.array(v, dtype=float) for i, v in rows}
    result = {}
    for q in asked:
        a = rows[q]
        near = [(-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in rows.items() if i != q]
        result[q] = [i for _, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return result


def found(df):
    result = {}
    for r in df.orderBy("query_id", "rank").collect():
        result.setdefault(r["query_id"], []).append(r["vec_id"])
    return result


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], r[1]) for r in table.collect()]
    got = found(nn.query(spark, sf_dir))
    want = plain(rows, [i for i, _ in rows if i % nn.EVERY == 0])
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / nn.K for q in want]) >= 0.9


def test_recall_over_many_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nn.search(table, table.where("vec_id % 100 = 0"), sample=2000, block_rows=300))
    want = plain(rows, range(0, 6000, 100))
    assert np.mean([len(set(got[q]) & set(want[q])) / nn.K for q in want]) >= 0.9
    router = nn.fit(np.array([v for _, v in rows[:2000]]), 6000)
    assert router.visits(nn.unit(np.array([v for _, v in rows[:200]]))).mean() < 0.9


def test_parts_are_balanced():
    vectors = nn.unit(np.random.default_rng(2).normal(size=(600, 8)))
    sizes = np.bincount(nn.partition(nn.graph(vectors), 3))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1


def test_a_query_in_a_small_part_finds_k_others(spark, monkeypatch):
    """Vectors near the first axis are few, and the router is sure of them."""
    sure = nn.Router(np.eye(2) * 50, np.zeros(2), np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros(2), 0.5)
    monkeypatch.setattr(nn, "fit", lambda *a: sure)
    rows = [(i, [1.0, 0.01 * i]) for i in range(3)] + [(i, [0.001 * i, 1.0]) for i in range(3, 60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nn.search(table, table.where("vec_id IN (0, 50)")))
    assert got == plain(rows, [0, 50])


def test_ties_and_rows_that_take_no_part(spark):
    same, other = [1.0, 2.0, 0.0], [0.5, -1.0, 3.0]
    rows = [(i, same) for i in range(0, 40)] + [(i, other) for i in range(40, 43)] + [
        (50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]),
        (54, [float("inf"), 1.0, 1.0]), (55, []), (56, [1.0]), (None, same), (3, same)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nn.search(table, table.where(F.col("vec_id").isin(0, 7, 41, 50, 51, 53, 56))))
    assert got == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4], 41: [40, 42, 0, 1, 2]}


def test_few_and_none(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(nn.search(table, table)) == {1: [2], 2: [1]}
    assert nn.search(table.limit(0), table).count() == 0
    assert nn.search(table.limit(1), table.limit(1)).count() == 0


def test_each_length_is_searched_among_its_own(spark):
    rows = [(i, [1.0, 0.1 * i]) for i in range(8)] + [(i, [1.0, 0.0, 0.1 * i]) for i in range(8, 12)]
    rows += [(12, [2.0] * 5)]
    table = spark.createDataFrame([(*r, 1.0, "clash", [1]) for r in rows],
                                  "vec_id long, embedding array<double>, score double, rep string, "
                                  "ids array<int>")
    got = found(nn.search(table, table.where("vec_id IN (0, 9, 12)")))
    assert got == {0: plain(rows[:8], [0])[0], 9: plain(rows[8:12], [9])[9]}


def test_small_tables_have_several_parts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL")
    vectors = np.array([r[0] for r in table.select("embedding").collect()], dtype=float)
    assert nn.fit(vectors, len(vectors)).w2.shape[1] >= 4

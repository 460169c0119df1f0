"""Joins over hot keys give what plain joins give, and split the hot groups."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators.asof import asof_join
from wardline.operators.skew import add_salt, count_rows, hot_keys, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "warm", None, f"k{rng.randint(0, 40)}"]))
            for i in range(3000)]
    side = [(k, n) for n, k in enumerate(["hot", "warm", *[f"k{j}" for j in range(0, 30)]])]
    return (spark.createDataFrame(rows, "id int, k string"),
            spark.createDataFrame(side, "k string, v int"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("options", [{}, {"parts": 20, "min_rows": 1}])
def test_salted_join_is_a_plain_join(skewed, how, options):
    facts, side = skewed
    got = salted_join(facts, side, ["k"], ["id"], how, **options)
    want = facts.join(side, "k", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_salted_join_to_several_rows_per_key(skewed):
    facts, side = skewed
    twice = side.unionByName(side.withColumn("v", F.col("v") + 100))
    got = salted_join(facts, twice, ["k"], ["id"], "inner", parts=20, min_rows=1)
    want = facts.join(twice, "k")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_groups_are_split(skewed):
    facts, _ = skewed
    hot = hot_keys(count_rows(facts, ["k"]), ["k"], 20, 1)
    assert {r["k"] for r in hot.collect()} == {"hot", "warm"}
    salted = add_salt(facts, hot, ["k"], ["id"], 20)
    largest = salted.groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 250 < facts.where("k = 'hot'").count()
    assert hot_keys(count_rows(facts, ["k"]), ["k"]) is None


def brute_force(facts, changes):
    out = {}
    for fid, key, ts in facts:
        seen = [(t, s, v) for k, t, s, v in changes
                if k == key and key is not None and ts is not None and t <= ts]
        out[fid] = max(seen)[2] if seen else None
    return out


@pytest.mark.parametrize("options", [
    {}, {"bucket_seconds": 7}, {"bucket_seconds": 600, "parts": 40, "min_rows": 2},
    {"bucket_seconds": 3600, "parts": 400, "min_rows": 1}])
def test_asof_join_agrees_with_brute_force(spark, options):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)

    def time():
        return start + timedelta(seconds=rng.choice([5, 5, 5, rng.randint(0, 4000)]),
                                 microseconds=rng.choice([0, rng.randint(0, 999_999)]))

    keys = ["a", "a", "a", "b", "c", None]
    facts = [(i, rng.choice(keys), time() if rng.random() < .97 else None) for i in range(900)]
    changes = [(rng.choice(keys), time(), i, f"v{i}") for i in range(150)]
    got = asof_join(spark.createDataFrame(facts, "id int, k string, at timestamp"),
                    spark.createDataFrame(changes, "k string, since timestamp, n int, v string"),
                    ["k"], ts="at", change_ts="since", seq="n", payload=["v"], spread=["id"],
                    **options)
    assert got.columns == ["id", "k", "at", "v"]
    assert {r["id"]: r["v"] for r in got.collect()} == brute_force(facts, changes)


@pytest.mark.parametrize("options", [{}, {"parts": 30, "min_rows": 1}])
def test_asof_join_without_keys(spark, options):
    start = datetime(2024, 1, 1)
    facts = [(i, "x", start + timedelta(minutes=i)) for i in range(200)]
    changes = [("x", start + timedelta(minutes=13 * i, seconds=30), i, f"v{i}") for i in range(9)]
    got = asof_join(spark.createDataFrame(facts, "id int, k string, at timestamp"),
                    spark.createDataFrame(changes, "k string, since timestamp, n int, v string"),
                    [], ts="at", change_ts="since", seq="n", payload=["v"], spread=["id"],
                    **options)
    assert {r["id"]: r["v"] for r in got.collect()} == brute_force(facts, changes)

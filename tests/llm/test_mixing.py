from collections import defaultdict

import pytest
from cases import words

from wardline.llm import mixing


def water(sizes, weights=mixing.WEIGHTS, most=mixing.MOST_COPIES):
    """Targets by sharing the rest again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {}
    while True:
        free = [s for s in order if s not in target]
        rest = sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > most * sizes[s]]
        if not above:
            return {**target, **{s: level * weight[s] for s in free}}
        target |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 100, "b": 1, "c": 2, None: 5}, {"a": 5},
    {"a": 0, "b": 7}, {"é": 3, "z": 900, "A": 1, "b": 40, "c": 2}, {None: 4, "x": 0}])
def test_targets(spark, sizes):
    docs = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["mix_source"]: r["target"] for r in mixing.targets(docs).collect()}
    assert found == pytest.approx(water(sizes))


def test_edges(edges):
    plan = mixing.plan_mix(edges).collect()
    total = defaultdict(int)
    for r in plan:
        assert r["size"] == len(words(r["text"])) and 0 <= r["copies"] <= mixing.MOST_COPIES
        total[r["source"]] += r["size"]
    want = water(total)
    for r in plan:
        assert r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    mixed = mixing.mix(edges)
    assert mixed.columns == edges.columns
    assert mixed.where("rate NOT LIKE 'rate-%'").count() == 0
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(edges).collect()))


def test_many_documents_come_near_the_target(spark):
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('w ', 5) AS text", "concat('s', id % 3) AS source")
    found = mixing.plan_mix(docs).selectExpr("source", "target", "size * copies AS taken").groupBy(
        "source").agg({"target": "max", "taken": "sum"}).collect()
    for r in found:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.08)


def test_nothing(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.plan_mix(nothing).count() == 0

"""What the Python workers of the operators hold at a time."""

import re
from pathlib import Path

import pyarrow as pa

from wardline.llm.batches import SLICE_BYTES, giving_back
from wardline.llm.common import BATCH_SETTING, ship


def sizes(session):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = session.range(0, 200, 1, 1).selectExpr("repeat('a', 200000) AS text")
    return [r["n"] for r in texts.mapInArrow(batch_sizes, "n long").collect()]


def test_batches_hold_a_slice(spark):
    session = spark.newSession()
    ship(session)
    found = sizes(session)
    assert max(found) <= SLICE_BYTES + 300_000 and sum(found) >= 200 * 200_000


def test_own_setting_of_batches_stays(spark):
    session = spark.newSession()
    session.conf.set(BATCH_SETTING, 1 << 20)
    ship(session)
    assert max(sizes(session)) <= (1 << 20) + 300_000


def held_mb():
    found = re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    return int(found[1]) / 1024


def test_task_gives_memory_back():
    left = []

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            left.append(held[-1])  # what lies above all others keeps them from being given back
            del held
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
    before = held_mb()
    assert list(giving_back(run)([batch])) == [batch]
    assert held_mb() - before < 50


def test_giving_back_keeps_all_batches():
    assert list(giving_back(iter)([])) == []
    assert list(giving_back(iter)([1, 2, 3])) == [1, 2, 3]

"""Every registered query agrees with its SQL."""

import os

import check_oracles
import pytest

import __spark_entry__ as entry_point
from wardline.operators import skew
from wardline.plans.oracles import ORACLES
from wardline.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return check_oracles.connect(SF_DIR)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    assert check_oracles.compare(spark, connection, SF_DIR, name) is None


@pytest.mark.parametrize("name", ["token_verdicts", "eligibility", "access_decisions",
                                  "multi_user_extract", "consented_rows", "state_read"])
def test_split_joins_agree_with_sql(spark, connection, monkeypatch, name):
    """Without adaptive execution every key with a share of the rows is split."""
    monkeypatch.setattr(skew, "MIN_ROWS", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert check_oracles.compare(spark, connection, SF_DIR, name) is None
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_every_allowed_call_has_its_rows(spark):
    """Not those of the first call alone."""
    allowed = {r["call_id"] for r in QUERIES["token_verdicts"](spark, SF_DIR).collect()
               if r["verdict"] == "ALLOWED"}
    calls = QUERIES["governed_calls"](spark, SF_DIR).collect()
    assert {r["call_id"] for r in calls} == allowed and len(allowed) > 1
    rows = QUERIES["governed_read_rows"](spark, SF_DIR).collect()
    assert {r["read_id"] for r in rows} <= {r["read_id"] for r in calls if r["readable"]}
    one = QUERIES["governed_call_rows"](spark, SF_DIR).collect()
    ids = {r["read_id"] for r in calls if one and r["call_id"] == one[0]["call_id"]}
    assert {r["p_partkey"] for r in one} <= {r["p_partkey"] for r in rows if r["read_id"] in ids}


def test_flagship(spark):
    assert entry_point.entry(spark).count() == 3

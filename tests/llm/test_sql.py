"""Queries that SQL can express agree with it; the others give a row per document."""

import check_oracles
import pytest

from wardline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    result = check_oracles.connect(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert check_oracles.rows_of(found.columns, found.collect()) == check_oracles.rows_of(
        columns, result.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, columns", [
    ("op3_sentencepiece", {"doc_id", "n_tokens", "tokens", "decoded_md5"}),
    ("op5_token_counts", {"doc_id", "n_bytes", "n_tokens", "over_limit"}),
    ("op10_html_text", {"page_id", "url", "text", "n_chars"})])
def test_row_for_each_row(spark, sf_dir, name, columns):
    found = QUERIES[name](spark, sf_dir)
    assert set(found.columns) == columns
    table = "pages" if name.startswith("op10") else "documents"
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()

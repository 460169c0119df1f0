import pytest
from cases import BASE, CLASHES, EDGES, SF_DIR


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*r, len(r[1] or ""), *[f"{c}-{i}" for c in CLASHES]) for i, r in enumerate(EDGES)]
    return spark.createDataFrame(rows, BASE + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], BASE + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Compare registered queries with their SQL: python tests/check_oracles.py SF_DIR [names]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardline.plans.oracles import ORACLES  # noqa: E402
from wardline.plans.queries import QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} against {w}"
    types = [(type(a), type(b)) for g, w in zip(got, want) for a, b in zip(g, w)
             if type(a) is not type(b)]
    return f"types {types[0]}" if types else None


if __name__ == "__main__":
    from wardline.session import local_session

    session, db = local_session(8), connect(sys.argv[1])
    for query in sys.argv[2:] or list(ORACLES):
        start = time.time()
        try:
            problem = compare(session, db, sys.argv[1], query)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {error}"
        verdict = "ok" if problem is None else "DIFFERS " + problem[:900]
        print(f"{query:28s} {time.time() - start:6.2f} {verdict}", flush=True)

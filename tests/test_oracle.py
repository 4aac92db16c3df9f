"""Every registered query against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from growthlens.plans.registry import all_queries
from tools.oracle_check import digest

from tests.conftest import SMALL

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(os.path.join(SMALL, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    q = QUERIES[name]
    df = q.build(spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if q.oracle is None:
        assert len(df.columns) > 0
        return
    cur = duck.execute(q.oracle)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows, 9)[0] == digest(ocols, orows, 9)[0]

"""The queries with SQL give DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from vecmesh.llm import entries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    expected = con.execute(entries.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    found = entries.queries()[name](spark, DATA).select(*columns)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected.fetchall())


def test_queries_cover_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 11))

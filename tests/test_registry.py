"""Every query with SQL against DuckDB on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tests.conftest import DATA
from vantor.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(v):
    return round(float(v), 7) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    want = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(same(r[c]) for c in names) for r in df.collect()), key=str) == sorted((tuple(map(same, r)) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "vec_id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries that SQL can state, against DuckDB on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tests.llm.conftest import SF
from vantor.llm.queries import ORACLE_SQL, QUERIES


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(same(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(same, r)) for r in want.fetchall()), key=str)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))

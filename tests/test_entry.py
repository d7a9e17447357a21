"""The driver's contract, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from caselens.plans import catalogue, evidence  # noqa: F401  evidence adds its queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_is_listed():
    known = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(known) and set(catalogue.QUERIES) <= set(known)


def _rows(rows: list[tuple]) -> list[tuple]:
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_against_sql(spark, database, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = database.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert _rows([tuple(r[c] for c in columns) for r in df.collect()]) == _rows([tuple(r[k] for k in place) for r in want.fetchall()])

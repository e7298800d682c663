"""Every query with SQL against DuckDB, and the driver's contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gramwise.plans import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

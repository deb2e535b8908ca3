"""The driver's contract: every query runs and, where there is SQL, agrees with it on the smallest data."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from graphloom import queries as library

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def shown(x) -> str:
    if hasattr(x, "__iter__") and not isinstance(x, str):
        return str(list(x))
    if x is None or x != x:
        return ""
    return f"{x:.6f}" if isinstance(x, float | Decimal) else str(x)


def rows(frame):
    """Rows of a Spark frame or of a DuckDB result, columns by name."""
    names, found = (frame.columns, frame.collect()) if hasattr(frame, "collect") else ([c[0] for c in frame.description], frame.fetchall())
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(shown(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(library.ORACLE))
def test_query_agrees_with_its_sql(spark, duck, name):
    assert rows(library.QUERIES[name](spark, DATA)) == rows(duck.execute(library.ORACLE[name]))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 10

"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from quillspark.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "NULL" if v is None else ("nan" if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rel = duck.sql(SQL[name])
    assert told(df.columns, [tuple(r) for r in df.collect()]) == told(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())

"""Driver contract: entry() runs; every oracle query matches DuckDB at sf0.001."""

import os

import pytest

import __spark_entry__ as E
from conftest import SF001
from tools.check_oracle import TABLES, rows_key, type_mismatches


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "rank", "item_id", "title", "year", "genres", "score",
                          "why_explainer"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    srows, scols = df.collect(), df.columns
    cur = duck.execute(E.oracle_sql()[name])
    drows, dcols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(scols) == sorted(dcols)
    assert type_mismatches(df.dtypes, duck.sql(E.oracle_sql()[name])) == {}
    assert rows_key(srows, scols) == rows_key(drows, dcols)

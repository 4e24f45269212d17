"""Every listed query against its SQL in DuckDB, on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import KINDS, TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.catalog.QUERIES, entry.catalog.SQL


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    result = con.execute(SQL[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    assert sorted(df.columns) == sorted(kinds)
    assert {c: KINDS.get(k) for c, k in df.dtypes} == kinds
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_cross_joins(spark):
    """No plan pairs all rows with all rows."""
    for name, run in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name

"""Every catalogue query against its SQL in DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalogue, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    want = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(oracle.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0

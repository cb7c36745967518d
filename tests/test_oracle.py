"""Every query with an oracle matches DuckDB on the small scale factor (the driver's gate
runs the same comparison at sf0.01; scripts/check_oracle.py does it by hand)."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, rows_of
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_runs_and_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "window_start" in df.columns
    missing = [n for n in E.queries() if n not in SQL]
    for n in missing:
        assert E.queries()[n](spark, SF_SMALL).count() > 0, n

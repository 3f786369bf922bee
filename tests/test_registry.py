"""Every checked query against its SQL, at the smallest scale."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_points  # noqa: E402
from check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert compare(rows, duck.execute(SQL[name]).df()) is None


def test_moments_of_one_second_are_one_row(spark, tmp_path):
    for table in ("customer", "events"):
        shutil.copyfile(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet")
    events = duckdb.sql(f"SELECT * FROM '{SF}/events.parquet' UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id, date_trunc('second', ts) AS ts) FROM '{SF}/events.parquet'")
    events.write_parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for table in ("customer", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    rows = QUERIES["active_companies"](spark, str(tmp_path)).toPandas()
    assert len(rows) and compare(rows, con.execute(SQL["active_companies"]).df()) is None


def test_flagship_runs(spark):
    assert "significance_classification" in entry_points.entry(spark).columns

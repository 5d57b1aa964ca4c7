"""Every query with SQL gives the rows of its SQL; the others run. On the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry_module
from phyllary.plans import registry


def _plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(_plain, r)) for r in df.select(columns).collect()), key=str)
    if name in registry.oracle_sql():
        rel = duck.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert rows == sorted((tuple(map(_plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["table_name", "row_id", "normal_text"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

from __future__ import annotations

import glob
import os

import pytest

from phyllary.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


FOUND = {
    "p4_found": ["group_seq", "field_name", "seq"], "p6_found": ["name_a", "name_b"], "p7_found": ["seq", "field_name", "entry_id"], "p10_found": ["doc_id", "sent_no", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns == FOUND[name]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, rel = queries.QUERIES[name](spark, sf), con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(rel.select(*[f'"{c}"' for c in columns]).fetchall())

import os

import duckdb
import pytest

import __spark_entry__

CHEAP = ["f2_ean_checksum", "a9_build_catalog", "w1_top_candidates", "j16_tile_grid", "a18_decode_summary", "p18_u3_colour_and_confidence"]


def canon(rows):
    form = lambda v: "" if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(str(form(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(cols)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert canon(df.select(*cols).collect()) == canon(want)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

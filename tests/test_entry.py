import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
HELD = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", [n for n in HELD if n in entry.oracle_sql()])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    assert sorted(df.columns) == cols
    at = [[c[0] for c in want.description].index(c) for c in cols]
    rows = sorted(repr([bytes(r[i]) if isinstance(r[i], (bytes, bytearray)) else r[i] for i in at]) for r in want.fetchall())
    assert sorted(repr([bytes(r[c]) if isinstance(r[c], (bytes, bytearray)) else r[c] for c in cols]) for r in df.collect()) == rows

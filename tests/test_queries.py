"""Registered queries against their SQL on the smallest tables, if the driver's tables are here."""

import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op")}


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return str(x)
    return round(float(x), 5) + 0.0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DIR)
    cols, want = sorted(df.columns), c.sql(SQL[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(k) for k in cols]
    assert sorted([[plain(r[k]) for k in cols] for r in df.collect()], key=str) == sorted([[plain(r[i]) for i in at] for r in want.fetchall()], key=str)

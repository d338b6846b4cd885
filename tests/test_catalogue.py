import os

import duckdb
import pytest

import __spark_entry__ as entry
from cadenza.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    got = catalogue.QUERIES[name](spark, DIR)
    rows = got.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = c.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(n) for n in got.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(map(plain, r)) for r in rows), key=key) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

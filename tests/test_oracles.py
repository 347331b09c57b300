"""Every query with SQL against DuckDB, as multisets of rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(rel.columns) == names
    order = [rel.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
    assert got == want, (list((got - want).elements())[:3], list((want - got).elements())[:3], got.total(), want.total())
    assert got

"""The queries with SQL against DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from arbora.llm import queries

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    folder = SMALL.replace("0.001", "0.01")
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    want = Counter(tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall())
    assert got == want, (list((got - want).elements())[:3], list((want - got).elements())[:3])

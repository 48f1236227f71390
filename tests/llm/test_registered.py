"""The registered queries: one per operator, and those with SQL against it."""

import duckdb
import pytest

import __spark_entry__
from quillspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())

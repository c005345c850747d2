"""Queries with SQL agree on the smallest tables; the others keep what must hold."""

import os

import duckdb
import pytest

from sparrix.llm import queries, sql


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


def rounded(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, int | float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    rel = duck.execute(sql.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    assert rounded(tuple(r[c] for c in columns) for r in df.collect()) == rounded(tuple(r[i] for i in at) for r in rel.fetchall())


def test_shares_reached(spark, data):
    rows = queries.p8_shares(spark, data).collect()
    assert len(rows) == 8 and abs(sum(r["share"] for r in rows) - 1) < 1e-9

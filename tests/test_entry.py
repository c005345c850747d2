"""The driver contract: queries and their SQL agree on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparrix.plans import matrix, records, surface


def rounded(rows):
    return sorted((tuple(round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (2, 3, 4):
        assert f"p{n}_found" in entry.queries()


@pytest.mark.parametrize("name", sorted((set(matrix.queries()) | set(records.queries())) & set(entry.oracle_sql())))
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = rounded(tuple(r[c] for c in columns) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    assert got == rounded(tuple(r[i] for i in at) for r in rel.fetchall())


def test_every_query_of_the_surface_has_sql():
    assert set(surface.queries()) == set(surface.oracle_sql()) and set(surface.queries()) <= set(entry.queries())


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    assert entry.entry(spark).count() > 0


def test_samples_are_whole(spark, data):
    for name in ("subsample_without_replacement", "subsample_with_replacement", "subsample_by_hash", "subsample_by_id"):
        matrix.queries()[name](spark, data).count()


def test_a_broken_import_is_reported(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError(name="numpy" if name.endswith("queries") else name)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert entry._llm("sql") is None
    with pytest.raises(ModuleNotFoundError):
        entry.queries()

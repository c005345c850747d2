import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sparrix.llm import cooccur
from sparrix.llm.cooccur import cooccurrence, log_likelihood_ratio
from sparrix.llm.queries import queries

SCHEMA = "obs_id string, samp_id string, value double, item string, n long"


def plain(rows, least, lift):
    baskets = {}
    for o, s, v in rows:
        if o is not None and s is not None and v is not None and v != 0 and v == v:
            baskets.setdefault(s, set()).add(o)
    n, single, both = len(baskets), {}, {}
    for items in baskets.values():
        for a in items:
            single[a] = single.get(a, 0) + 1
        for p in combinations(sorted(items), 2):
            both[p] = both.get(p, 0) + 1
    return {(a, b, c, single[a], single[b], n) for (a, b), c in both.items() if c >= least and c * n >= lift * single[a] * single[b]}


def run(spark, rows, least, lift):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = cooccurrence(df, min_count=least, min_lift=lift, min_llr=0.0).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def rows_of(seed):
    rng = np.random.default_rng(seed)
    out = [(f"i{x}", f"b{k}", float(rng.integers(0, 3))) for k in range(150) for x in rng.choice(30, 5, replace=False)]
    out += [(x, f"b{k}", 1.0) for k in range(0, 150, 11) for x in ("Z", "a", "é")]
    out += [("hot", f"b{k}", 2.0) for k in range(140)] + [(f"i{x}", "big", 1.0) for x in range(30)]
    return out + out[:40] + [(None, "b1", 1.0), ("i1", None, 1.0), ("i2", "b2", None), ("i3", "only", 0.0)]


def test_against_plain(spark):
    rows = rows_of(3)
    for least, lift in ((2, 1.0), (5, 1.3), (10, 8.0)):
        expected = plain(rows, least, lift)
        assert expected and run(spark, rows, least, lift) == expected


def test_small_steps_and_shuffled_items(spark, monkeypatch):
    """Blocks of a large basket, stripes that do not fit and items that are not broadcast."""
    monkeypatch.setattr(cooccur, "BLOCK", 4)
    monkeypatch.setattr(cooccur, "PAIRS_AT_ONCE", 40)
    monkeypatch.setattr(cooccur, "BROADCAST_ITEMS", 0)
    rows = rows_of(4)
    assert run(spark, rows, 3, 1.1) == plain(rows, 3, 1.1)


def test_right_at_the_bounds(spark):
    """12 of 96 baskets each, all together: a ratio of exactly 8."""
    rows = [(x, f"b{k}", 1.0) for k in range(12) for x in "ab"] + [("c", f"b{k}", 1.0) for k in range(12, 96)]
    assert run(spark, rows, 12, 8.0) == {("a", "b", 12, 12, 12, 96)}
    assert run(spark, rows + [("a", "b95", 1.0)], 12, 8.0) == set()
    assert run(spark, rows, 13, 8.0) == set() and run(spark, [], 1, 1.0) == set()


def test_ratio(spark):
    df = spark.createDataFrame([(10, 20, 30, 100), (5, 5, 5, 10), (6, 20, 30, 100)], "k long, a long, b long, n long")
    for r in df.select("*", log_likelihood_ratio(F.col("k"), F.col("a"), F.col("b"), F.col("n")).alias("g")).collect():
        table = [(r["k"], r["a"], r["b"]), (r["a"] - r["k"], r["a"], r["n"] - r["b"]), (r["b"] - r["k"], r["n"] - r["a"], r["b"]), (r["n"] - r["a"] - r["b"] + r["k"], r["n"] - r["a"], r["n"] - r["b"])]
        assert math.isclose(r["g"], 2 * sum(k * math.log(k * r["n"] / (x * y)) for k, x, y in table if k), abs_tol=1e-9)


def test_all_pairs_are_registered(spark, tmp_path):
    """Pairs of one common sample and those of an item that is in nearly all samples."""
    rows = rows_of(5)
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/cells.parquet")
    got = [tuple(r)[:6] for r in queries()["p5_all_pairs"](spark, str(tmp_path)).collect()]
    expected = plain(rows, 1, 0.0)
    assert set(got) == expected and len(got) == len(expected)
    assert min(r[2] for r in expected) == 1 and any("hot" in r[:2] for r in expected)


def test_significance(spark):
    """Pairs under the bound are left out, and only those; no pair of p5_found is under it."""
    df = spark.createDataFrame([(*r, "x", 1) for r in rows_of(6)], SCHEMA)
    every = {tuple(r) for r in cooccurrence(df, min_count=2, min_lift=1.0, min_llr=0.0).collect()}
    kept = {tuple(r) for r in cooccurrence(df, min_count=2, min_lift=1.0).collect()}
    assert kept == {r for r in every if r[-1] >= 10.83} and 0 < len(kept) < len(every)
    for k in (12, 30, 500):
        for lift in (8.0, 20.0):
            for share in (1.0, 2.0, 10.0):  # n(a) = k * share and so on
                na = nb = k * share
                n = lift * na * nb / k
                if n < na + nb:
                    continue
                cells = [(k, na, nb), (na - k, na, n - nb), (nb - k, n - na, nb), (n - na - nb + k, n - na, n - nb)]
                assert 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o > 0) >= 28.9


def test_stripe_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "PARTS", 3)
    monkeypatch.setattr(cooccur, "MANY_BASKETS", 20)
    rows = rows_of(7)
    assert run(spark, rows, 1, 0.0) == plain(rows, 1, 0.0)
    assert len(list(cooccur._stripes(5, True)(iter([])))) == 0

"""Samples, packing and mixing: what must hold for any result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrix.llm import mix, pack, stable
from sparrix.llm.mix import SourceMix, block_pieces, permuted, quotas
from sparrix.llm.pack import configurations, knapsack, pack_all, plan_containers
from sparrix.llm.stable import StableSample, lost_keys
from sparrix.llm.tokens import FOLDER, count_tokens, token_counts

# -- stable samples


def keys(spark, n=1500):
    rows = [(f"id{i}", None if i % 11 == 0 else f"s{i % 4}" if i % 50 else "rare", 1 + i * 5 // n, 1.0, "x") for i in range(n)]
    return spark.createDataFrame(rows + rows[:100] + [(None, "s1", 1, 1.0, "x")], "id string, site string, load_no int, u double, key string")


def chosen(sample):
    return {r["key"] for r in sample.sample().collect()}


def sampled(df, **options):
    return StableSample(df, "id", F.col("site"), "load_no", **{"rate": 0.1, "rates": {"rare": 0.6, None: 0.3}} | options)


def test_sample_only_grows(spark):
    df, before = keys(spark), set()
    for load in range(1, 6):
        now = chosen(sampled(df.where(F.col("load_no") <= load)))
        assert before <= now and now
        before = now
    assert chosen(sampled(df.orderBy(F.rand(1)).repartition(7))) == before
    rates = {r["stratum"]: (r["threshold"], r["keys"], r["chosen"]) for r in sampled(df).thresholds().collect()}
    assert rates["rare"][0] == 0.6 and rates[None][0] == 0.3 and rates["s1"][0] == 0.1 and rates["rare"][2] >= 5
    assert sum(r[2] for r in rates.values()) == len(before)
    assert chosen(sampled(df, salt="other")) != before
    assert lost_keys(df, [1, 2, 3, 4, 5], "load_no", sampled).count() == 0


def test_late_and_resent_rows_lose_nothing(spark):
    """Many rows of an old or no delivery arrive late, and ids come again in another stratum."""
    df = spark.createDataFrame([(f"k{i}", "s", 1 + i % 3) for i in range(200)], "id string, site string, load_no int")
    before = chosen(sampled(df))
    late = [(f"x{i}", "s", (None, 1, 3)[i % 3]) for i in range(3000)]
    resent = [(f"k{i}", (None, "t", "rare")[i % 3], 4) for i in range(200)]
    more = df.unionByName(spark.createDataFrame(late + resent, df.schema))
    assert before and before <= chosen(sampled(more))
    # an id without a stratum at first, of a high rate, and later with one of a low rate
    first = spark.createDataFrame([(f"n{i}", None, 1) for i in range(60)], df.schema)
    again = first.unionByName(spark.createDataFrame([(f"n{i}", "s", 2) for i in range(60)], df.schema))
    assert chosen(sampled(first)) and chosen(sampled(first)) <= chosen(sampled(again))


def test_thresholds_are_never_lowered(spark, monkeypatch):
    df = keys(spark)
    high = sampled(df.where("load_no = 1"), rate=0.5, rates={})
    for bound in (50_000, 0):  # broadcast, and joined in parts
        monkeypatch.setattr(stable, "BROADCAST_STRATA", bound)
        later = sampled(df, rate=0.01, rates={}, earlier=high.thresholds())
        assert chosen(high) <= chosen(later)
        assert {r["threshold"] for r in later.thresholds().collect()} == {0.5}
    assert chosen(sampled(df, rate=0.0, rates={"s1": 1.0})) == {r["id"] for r in df.where("site = 's1' and id is not null").collect()}
    assert chosen(sampled(df.limit(0))) == set()


def test_key_with_several_strata(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1)], "id string, site string, load_no int")
    assert chosen(sampled(df, rate=0.0, rates={"y": 1.0})) == {"a"}


# -- packing


def test_knapsack():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes, values, room = rng.integers(1, 9, 4), rng.random(4), int(rng.integers(1, 25))
        fill = knapsack(values, sizes, room)
        best = np.zeros(room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c])
        assert (fill * sizes).sum() <= room and (fill * values).sum() == pytest.approx(best[room])


def test_configurations_cover():
    sizes, demand = np.array([60, 40, 35, 25]), np.array([10.0, 10.0, 30.0, 5.0])
    found = configurations(sizes, demand, 100)
    cover = sum(f * x for f, x in found)
    assert (cover >= demand - 1e-9).all() and all((f * sizes).sum() <= 100 for f, _ in found)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([50, 512, 2048]))
    sizes = np.minimum(capacity, np.maximum(1, rng.lognormal(np.log(capacity / 6), 1.0, 3000).astype(int)))
    histogram = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True))
    plan = plan_containers(histogram, capacity)
    used = {}
    for fill, times in plan:
        assert times > 0 and sum(s * n for s, n in fill.items()) <= capacity
        for s, n in fill.items():
            used[s] = used.get(s, 0) + n * times
    assert used == histogram
    assert sum(t for _, t in plan) <= 1.04 * -(-sizes.sum() // capacity) + 2


def test_hard_plan():
    """90 containers are enough; largest first, 110 are needed."""
    histogram = {51: 60, 27: 60, 26: 60, 23: 120}
    assert sum(t for _, t in pack._largest_first(dict(histogram), 100)) == 110
    assert sum(t for _, t in plan_containers(histogram, 100)) <= 93
    assert sum(t for _, t in plan_containers({51: 60, 27: 60, 22: 60}, 100)) == 60
    assert plan_containers({}, 10) == [] and plan_containers({10: 3}, 10) == [({10: 1}, 3)]
    for bad in ({11: 1}, {0: 1}):
        with pytest.raises(ValueError):
            plan_containers(bad, 10)


def test_packed_frame(spark, monkeypatch):
    monkeypatch.setattr(pack, "BUCKET_ROWS", 40)  # a length of many texts is ranked in several buckets
    rng = np.random.default_rng(5)
    sizes = [(i, int(x)) for i, x in enumerate([1] * 400 + [512, 513, 5000, 1024] + rng.integers(1, 600, 300).tolist())]
    df = spark.createDataFrame(sizes + sizes[:50], "doc long, tokens long")
    kinds = spark.createDataFrame([("small", 512), ("large", 2048), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    rows = pack_all(df, kinds).collect()
    total = sum(n for _, n in sizes)
    for kind, capacity in (("small", 512), ("large", 2048)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert sum(r["tokens"] for r in mine) == total
        filled = {}
        for r in mine:
            filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
        assert max(filled.values()) <= capacity and set(filled) == set(range(len(filled))) and len(filled) <= 1.05 * total / capacity + 2
        pieces = {}
        for r in mine:
            pieces.setdefault(r["doc"], []).append(r["tokens"])
        for doc, n in sizes:  # only what exceeds the capacity is split, into full parts and a rest
            assert sorted(pieces[doc], reverse=True) == [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])
    assert {r["container_kind"] for r in rows} == {"small", "large"}
    assert pack_all(df.limit(0), kinds).count() == 0 and pack_all(df, kinds.where("capacity_tokens = 0")).count() == 0


# -- mixing


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (1, -5):
            out = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.int64))
            assert sorted(out.tolist()) == list(range(n))
    a, b = (permuted(np.arange(100), np.full(100, 100), np.full(100, k, np.int64)).tolist() for k in (1, 2))
    assert a != b and a != list(range(100))


def test_quotas():
    assert quotas({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, {"a": 1, "b": 1}) == {"a": 100, "b": 100}
    assert quotas({"a": 0.75, "b": 0.25}, {"a": 100, "b": 100}, {"a": 1, "b": 1}) == {"a": 100, "b": 33}
    assert quotas({"a": 0.5, "b": 0.5}, {"a": 100, "b": 20}, {"a": 1, "b": 3}) == {"a": 60, "b": 60}
    tiny = quotas({"a": 0.5, "b": 0.5}, {"a": 100, "b": 1}, {"a": 1, "b": 2})  # out of reach: half the blocks are used all the same
    assert tiny["b"] == 2 and tiny["a"] == 48
    assert quotas({"a": 1.0, "b": 0.0}, {"b": 5}, {"a": 1, "b": 1}) == {"a": 0, "b": 0}


def test_counts_are_multinomial_and_corrected():
    """Drawn counts have the quotas' means and a multinomial's variance; the correction hits the quotas and moves few slots."""
    quota = np.array([60_000, 25_000, 14_000, 1_000, 0])
    total, groups = quota.sum(), -(-quota.sum() // (mix.GROUP * mix.SHARD_BLOCKS))
    counts = np.concatenate([mix.drawn_counts(quota, g, 3) for g in range(groups)])
    assert counts.sum() == total and (counts.sum(axis=1)[:-1] == mix.SHARD_BLOCKS).all()
    p = quota / total
    full = counts[counts.sum(axis=1) == mix.SHARD_BLOCKS]
    assert full.var(axis=0)[:3] == pytest.approx(mix.SHARD_BLOCKS * (p * (1 - p))[:3], rel=0.15)
    drawn = counts.sum(axis=0)
    source = np.repeat(np.arange(5), drawn)
    t = np.concatenate([np.arange(n) for n in drawn])
    now, number = mix.settled(source, t, quota, drawn, 3)
    assert np.bincount(now, minlength=5).tolist() == quota.tolist()
    for s in range(5):  # the slots of a source are numbered without gaps
        assert sorted(number[now == s].tolist()) == list(range(quota[s]))
    assert 0 < (now != source).sum() == np.maximum(0, drawn - quota).sum() < 4 * np.sqrt(total)
    assert (mix.drawn_counts(quota, 1, 3) == mix.drawn_counts(quota, 1, 3)).all() and (mix.drawn_counts(quota, 1, 3) != mix.drawn_counts(quota, 1, 4)).any()


def test_blocks(spark, monkeypatch):
    sizes = [(i, "a" if i % 3 else "b", 1 + i * 7 % 90) for i in range(200)] + [(900, "a", 2000)]
    df = spark.createDataFrame(sizes, "doc long, source string, tokens long")
    monkeypatch.setattr(mix, "BUCKET_ROWS", 30)
    rows = block_pieces(df, 64, len(sizes)).collect()
    for doc, source, n in sizes:
        mine = sorted((r["from_token"], r["to_token"]) for r in rows if r["doc"] == doc)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
    filled = {}
    for r in rows:
        filled[r["source"], r["block"]] = filled.get((r["source"], r["block"]), 0) + r["to_token"] - r["from_token"]
    for s in "ab":
        blocks = [filled[s, b] for b in range(max(b for t, b in filled if t == s) + 1)]
        assert all(x == 64 for x in blocks[:-1]) and 0 < blocks[-1] <= 64


def test_mix(spark):
    sizes = [(i, s, 40 + i % 60) for i, s in enumerate("a" * 300 + "b" * 100 + "c" * 12 + "d" * 50)] + [(999, None, 10)]
    df = spark.createDataFrame(sizes + sizes[:20], "doc long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.1, 4), ("e", 0.15, 2)], "source string, target_share double, max_repeats int")
    m = SourceMix(df, targets, length=32)
    rows = m.mixed().collect()
    tokens, used = {}, {}
    for r in rows:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["to_token"] - r["from_token"]
        key = (r["source"], r["block"], r["doc"])
        used[key] = used.get(key, 0) + 1
    caps = {"a": 1, "b": 2, "c": 4}
    assert set(tokens) == set(caps) and all(n <= caps[k[0]] for k, n in used.items())
    shares = {r["source"]: r for r in m.shares_reached().collect()}
    total = sum(tokens.values())
    assert {s: r["tokens"] for s, r in shares.items()} == tokens | {"e": 0}
    assert shares["e"]["share"] == 0 and not shares["e"]["reached"]
    assert all(shares[s]["share"] == pytest.approx(tokens[s] / total) for s in caps)
    assert tokens["a"] / tokens["b"] == pytest.approx(2, rel=0.1)
    again = SourceMix(df.repartition(5), targets, length=32)
    assert sorted(map(tuple, again.mixed().collect())) == sorted(map(tuple, rows))
    slots = m.slots().collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) == sum(m.quota.values())
    taken = [(r["source"], r["repeat_no"], r["block"]) for r in slots]
    assert len(set(taken)) == len(taken)
    assert {s: sum(x[0] == s for x in taken) for s in m.quota} == m.quota
    assert SourceMix(df.limit(0), targets).mixed().count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("no vocabulary files")
    assert count_tokens(["", None, "hello world"]).tolist() == [0, 0, 2]
    df = spark.createDataFrame([(1, "hello world", "s", 5), (2, "", "s", 5), (3, None, "s", 5), (None, "x", "s", 5), (4, "x " * 50_000, "t", 5)], "doc_id long, text string, source string, tokens long")
    got = {r["doc"]: r for r in token_counts(df, keep=("source",)).collect()}
    assert set(got) == {1, 4} and got[1]["tokens"] == 2 and got[4]["source"] == "t" and got[4]["tokens"] >= 50_000

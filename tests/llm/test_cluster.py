"""Composition clusters against all pairs compared one by one."""

import numpy as np
import pytest

from sparrix.llm import cluster
from sparrix.llm.cluster import CompositionClusters

SCHEMA = "cell_id long, obs_id string, samp_id string, value double, record string, share double"


def frame(spark, triples):
    return spark.createDataFrame([(i, o, s, v, "x", 9.0) for i, (s, o, v) in enumerate(triples)], SCHEMA)


def plain_groups(triples, threshold=0.55):
    vectors = {}
    for s, o, v in triples:
        if s is not None and o is not None and v is not None and v == v and v != 0:
            vectors.setdefault(s, {}).setdefault(o, 0.0)
            vectors[s][o] += v
    vectors = {s: {o: x / sum(v.values()) for o, x in v.items()} for s, v in vectors.items() if min(v.values()) > 0 and sum(v.values()) < float("inf")}
    names = sorted(vectors)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if sum(min(x, vectors[b].get(o, 0)) for o, x in vectors[a].items()) >= threshold - 1e-9:
                root[find(a)] = find(b)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if find(a) == find(b)}, names


def random_triples(seed, samples=60, features=40, length=5, bases=12):
    rng = np.random.default_rng(seed)
    base = [(rng.choice(features, length, replace=False), rng.integers(1, 50, length)) for _ in range(bases)]
    out = []
    for i in range(samples):
        f, v = base[rng.integers(bases)]
        v = np.maximum(1, v + rng.integers(-8, 9, length)) * rng.integers(1, 4)
        out += [(f"s{i}", f"o{x}", float(y)) for x, y in zip(f, v, strict=True)]
        out += [(f"s{i}", "hot", float(rng.integers(1, 60)))]
    return out


def check(spark, triples):
    expected, names = plain_groups(triples)
    c = CompositionClusters(frame(spark, triples))
    got = [tuple(r) for r in c.group_pairs().collect()]
    assert set(got) == expected and len(got) == len(expected)
    clusters = c.clusters().collect()
    assert sum(r["size"] for r in clusters) == len(names) and len({r["cluster"] for r in clusters}) == len(clusters)
    assert all(r["medoid"] in names and len(r["typical"].split()) == min(3, r["size"]) for r in clusters)
    return c


def test_random_compositions(spark):
    check(spark, random_triples(1))


def test_hot_features_and_long_vectors(spark, monkeypatch):
    """Keys split by a second feature, one-feature alikeness, unpacked vectors and small steps give the same groups."""
    triples = random_triples(2)
    triples += [(f"d{i}", "hot", 100.0) for i in range(12)] + [(f"d{i}", f"o{i}", 20.0 + i) for i in range(12)]
    triples += [(f"l{i}", f"w{j}", 1.0 + (j % (i + 2) == 0)) for i in range(4) for j in range(30)]
    monkeypatch.setattr(cluster, "HOT_KEY", 5)
    monkeypatch.setattr(cluster, "PACKED_ENTRIES", 8)
    monkeypatch.setattr(cluster, "PAIRS_AT_ONCE", 50)
    check(spark, triples)


def test_copies_chains_and_odd_values(spark):
    copies = [(f"c{i}", o, v * (i + 1)) for i in range(15) for o, v in (("a", 3.0), ("b", 1.0))]
    chain = [(f"k{i}", f"f{j}", 1.0) for i in range(12) for j in range(i, i + 4)]  # neighbours share three of four
    odd = [("n", "a", -1.0), ("n", "b", 2.0), ("i", "a", float("inf")), ("z", "a", 0.0), (None, "a", 1.0), ("x", None, 1.0), ("x", "a", None), ("y", "a", float("nan")), ("one", "solo", 2.0)]
    tie = [("t1", "p", 55.0), ("t1", "q", 45.0), ("t2", "p", 55.0), ("t2", "r", 45.0)]  # exactly at the threshold
    check(spark, copies + chain + odd + tie)


def test_cells_sent_again(spark):
    rows = [(1, "a", "s", 2.0), (1, "a", "s", 2.0), (2, "b", "s", 2.0), (3, "a", "t", 2.0), (4, "b", "t", 2.0), (5, "c", "t", 1.0)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)
    c = CompositionClusters(df)
    assert [tuple(r) for r in c.group_pairs().collect()] == [("s", "t")]


def test_nothing(spark):
    c = CompositionClusters(frame(spark, [("s", "o", 1.0)]).limit(0))
    assert c.group_pairs().count() == 0 and c.clusters().count() == 0


@pytest.mark.parametrize("n", [1, 2, 9])
def test_all_alike(spark, n):
    c = CompositionClusters(frame(spark, [(f"s{i}", "o", 1.0 + i) for i in range(n)]))
    assert c.group_pairs().count() == n * (n - 1) // 2
    assert [r["size"] for r in c.clusters().collect()] == [n]


def test_clusters_of_a_hot_feature(spark, monkeypatch):
    """Clusters, sizes and medoids do not depend on which features are hot."""
    rng = np.random.default_rng(5)
    triples = random_triples(6)
    triples += [(f"d{i}", o, float(v)) for i in range(60) for o, v in (("hot", 100 + rng.integers(0, 40)), (f"o{rng.integers(40)}", 20 + rng.integers(0, 60)), (f"u{i}", 5.0))]
    df = frame(spark, triples)
    expected = sorted(tuple(r) for r in CompositionClusters(df).clusters().collect())
    monkeypatch.setattr(cluster, "HOT_KEY", 5)
    assert sorted(tuple(r) for r in CompositionClusters(df).clusters().collect()) == expected
    assert max(size for _, size, _, _ in expected) >= 30
    groups = {tuple(r) for r in CompositionClusters(df).group_pairs().collect()}
    assert groups == plain_groups(triples)[0]


def test_medoid_has_the_largest_sum_over_its_cluster(spark, monkeypatch):
    """All of one cluster: the sums over all others, compared one by one."""
    monkeypatch.setattr(cluster, "HOT_KEY", 5)
    triples = [(f"m{i:02}", o, v) for i in range(20) for o, v in (("hot", 100.0), (f"x{i % 7}", 10.0 + 3 * i), (f"y{i % 3}", 5.0))]
    vectors = {}
    for s, o, v in triples:
        vectors.setdefault(s, {})[o] = v
    vectors = {s: {o: x / sum(v.values()) for o, x in v.items()} for s, v in vectors.items()}
    sums = {a: round(sum(min(x, w.get(o, 0)) for w in vectors.values() for o, x in v.items()), 9) for a, v in vectors.items()}
    best = sorted(sums, key=lambda a: (-sums[a], a))
    assert [tuple(r) for r in CompositionClusters(frame(spark, triples)).clusters().collect()] == [(best[0], 20, best[0], " ".join(best[:3]))]


def test_tie_of_a_hot_feature(spark, monkeypatch):
    """Records whose share of a hot feature is the threshold itself, with no other feature in common."""
    monkeypatch.setattr(cluster, "HOT_KEY", 5)
    triples = [(f"t{i}", o, v * (i + 1)) for i in range(8) for o, v in (("p", 11.0), (f"q{i}", 9.0))]
    check(spark, triples)
    assert [r["size"] for r in CompositionClusters(frame(spark, triples)).clusters().collect()] == [8]


def plain_clusters(spark, triples, threshold=0.55):
    """Sequential pivot clustering in hash order over all pairs, members at their closest pivot, medoids by sums."""
    vectors = {}
    for s, o, v in triples:
        vectors.setdefault(s, {}).setdefault(o, 0.0)
        vectors[s][o] += v
    vectors = {s: {o: x / sum(v.values()) for o, x in v.items()} for s, v in vectors.items()}

    def alike(a, b):
        return sum(min(x, vectors[b].get(o, 0)) for o, x in vectors[a].items())

    h = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in vectors], "id string").selectExpr("id", "xxhash64(id)").collect()}
    links = {a: {b for b in vectors if a != b and alike(a, b) >= threshold - 1e-9} for a in vectors}
    pivots, gone = [], set()
    for a in sorted(vectors, key=lambda x: (h[x], x)):
        if a not in gone:
            pivots.append(a)
            gone |= {a} | links[a]
    members = {p: [p] for p in pivots}
    for a in vectors:
        if a not in members:
            members[max((p for p in pivots if p in links[a]), key=lambda p: (round(alike(a, p), 9), -h[p], p))].append(a)
    out = []
    for group in members.values():
        best = sorted(group, key=lambda a: (-round(sum(alike(a, b) for b in group), 9), a))
        out.append((best[0], len(group), best[0], " ".join(best[:3])))
    return sorted(out)


def hot_triples(seed):
    rng = np.random.default_rng(seed)
    triples = random_triples(seed)
    return triples + [(f"d{i}", o, float(v)) for i in range(60) for o, v in (("hot", 100 + rng.integers(0, 40)), (f"o{rng.integers(40)}", 20 + rng.integers(0, 60)), (f"u{i}", 5.0 + i))]


@pytest.mark.parametrize("hot, block", [(2000, 20_000), (5, 20_000), (5, 4)])
def test_plain_pivots(spark, monkeypatch, hot, block):
    """The clusters are those of a plain pivot clustering, whatever is hot and however keys are split."""
    monkeypatch.setattr(cluster, "HOT_KEY", hot)
    monkeypatch.setattr(cluster, "BLOCK_RECORDS", block)
    triples = hot_triples(8)
    c = CompositionClusters(frame(spark, triples))
    assert sorted(tuple(r) for r in c.clusters().collect()) == plain_clusters(spark, triples)
    assert {tuple(r) for r in c.group_pairs().collect()} == plain_groups(triples)[0]


def test_one_dominant_feature(spark, monkeypatch):
    """Records of one dominant feature and one of three others are one cluster."""
    monkeypatch.setattr(cluster, "HOT_KEY", 50)
    triples = [(f"r{i:03}", o, v) for i in range(120) for o, v in (("hot", 60.0 + i % 7), (f"x{i % 3}", 30.0))]
    assert [r["size"] for r in CompositionClusters(frame(spark, triples)).clusters().collect()] == [120]


def test_features_of_one_code(spark, monkeypatch):
    """Where packed codes do not tell features apart, all candidates are compared exactly."""
    triples = hot_triples(9)
    monkeypatch.setattr(cluster, "SHARE_BITS", 20)
    c = CompositionClusters(frame(spark, triples))
    assert c.codes_differ
    c.codes_differ = False
    assert {tuple(r) for r in c.group_pairs().collect()} == plain_groups(triples)[0]


def test_cells_named_by_text(spark):
    rows = [("1", "a", "s", 2.0), ("1", "a", "s", 2.0), ("2", "b", "s", 2.0), ("3", "a", "t", 2.0), ("4", "b", "t", 2.0), ("5", "c", "t", 1.0)]
    df = spark.createDataFrame(rows, "cell_id string, obs_id string, samp_id string, value double")
    assert [tuple(r) for r in CompositionClusters(df).group_pairs().collect()] == [("s", "t")]


def test_large_groups_and_clusters_in_parts(spark, monkeypatch):
    """Pairs of a group in parts, and medoid sums in steps, are those made at once."""
    triples = hot_triples(11)
    df = frame(spark, triples)
    expected = sorted(tuple(r) for r in CompositionClusters(df).clusters().collect())
    monkeypatch.setattr(cluster, "PART_RECORDS", 3)
    monkeypatch.setattr(cluster, "WINDOW_RECORDS", 10)
    monkeypatch.setattr(cluster, "STEPS", 5)
    c = CompositionClusters(df)
    assert sorted(tuple(r) for r in c.clusters().collect()) == expected
    got = [tuple(r) for r in c.group_pairs().collect()]
    assert set(got) == plain_groups(triples)[0] and len(got) == len(set(got))


def test_members_have_their_pivot(spark):
    triples = hot_triples(12)
    members = CompositionClusters(frame(spark, triples)).members().collect()
    _, names = plain_groups(triples)
    assert sorted(r["record"] for r in members) == names
    pivots = {r["pivot"] for r in members}
    assert {r["record"] for r in members if r["record"] == r["pivot"]} == pivots and all(r["similarity"] >= 0.55 - 1e-9 for r in members)

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrix import core
from sparrix.core import MatrixTable
from sparrix.errors import DisjointIDError, TableError, UnknownAxisError, UnknownIDError, errstate
from sparrix.functions.scalar import natural_key
from sparrix.operators import axis
from sparrix.operators.combine import newick_tips
from sparrix.plans import matrix, surface
from tests.helpers import dense, ids, make, pairs


@pytest.fixture(scope="module")
def example(spark):
    """Two observations, three samples, metadata on both axes."""
    return make(
        spark, [[0, 1, 2], [3, 4, 5]], ["O1", "O2"], ["S1", "S2", "S3"],
        [{"taxonomy": ["Bacteria", "Firmicutes"]}, {"taxonomy": ["Bacteria", "Bacteroidetes"]}],
        [{"environment": "A"}, {"environment": "B"}, {"environment": "A"}], type="OTU table",
    )


@pytest.fixture(scope="module")
def zeros(spark):
    """An all-zero sample, and an observation with a negative sum."""
    return make(spark, [[1, 0, 2, 0], [0, 3, 4, 0], [0, -5, 0, 0]], ["1", "2", "3"], ["a", "b", "c", "d"])


def test_shape_and_counts(example, zeros):
    assert example.shape == (2, 3) and example.nnz == 5 and not example.is_empty()
    assert example.density() == pytest.approx(5 / 6)
    assert repr(example).startswith("2 x 3") and "83% dense" in repr(example)
    assert zeros.nnz == 5 and zeros.length("observation") == 3 and zeros.dtype == "double"
    with pytest.raises(UnknownAxisError):
        example.length("rows")


def test_construction(spark):
    triples = MatrixTable.from_data(spark, [[0, 0, 1.0], [0, 0, 2.0], [1, 1, 4.0], [1, 0, 0.0]], ["x", "y"], ["p", "q"])
    assert dense(triples) == [[3, 0], [0, 4]]
    assert dense(MatrixTable.from_data(spark, [[1, 2, 3], [4, 5, 6]], ["x", "y"], ["p", "q", "r"], input_is_dense=True)) == [[1, 2, 3], [4, 5, 6]]
    assert dense(MatrixTable.from_data(spark, {(0, 1): 5}, ["x"], ["p", "q"])) == [[0, 5]]
    assert dense(MatrixTable.from_data(spark, [np.array([1, 0]), np.array([0, 2])], ["x", "y"], ["p", "q"])) == [[1, 0], [0, 2]]
    assert dense(MatrixTable.from_data(spark, [{(0, 0): 1, (0, 1): 2}, {(0, 1): 3}], ["x", "y"], ["p", "q"])) == [[1, 2], [0, 3]]
    assert dense(MatrixTable.from_data(spark, np.array([1, 2]), ["x"], ["p", "q"])) == [[1, 2]]
    for data, o, s in (([[0, 5, 1.0]], ["x"], ["p"]), ("text", ["x"], ["p"]), (np.ones((2, 2)), ["x"], ["p"])):
        with pytest.raises(TableError):
            MatrixTable.from_data(spark, data, o, s)
    with pytest.raises(TableError, match="duplicate"):
        MatrixTable.from_data(spark, [], ["x", "x"], ["p"])
    with pytest.raises(TableError):
        MatrixTable.from_data(spark, [], ["x"], ["p"], [{"a": 1}, {"a": 2}])


def test_triples_with_nulls_and_clashing_columns(spark):
    rows = [("o", "s", 1.0, 9), ("o", "s", 2.0, 9), (None, "s", 5.0, 9), ("o", None, 5.0, 9), ("p", "s", None, 9), ("q", "t", 0.0, 9)]
    df = spark.createDataFrame(rows, "obs_id string, samp_id string, value double, id int")
    t = MatrixTable.from_triples(df)
    assert ids(t, "observation") == ["o", "p", "q"] and ids(t) == ["s", "t"]
    assert dense(t) == [[3, 0], [0, 0], [0, 0]]


def test_empty_tables(spark):
    for o, s in (([], []), ([], ["a", "b"]), (["x", "y"], [])):
        t = MatrixTable.from_data(spark, [], o, s)
        assert t.is_empty() and t.shape == (len(o), len(s)) and t.density() == 0.0
        assert t.norm().nnz == 0 and t.rankdata().nnz == 0 and t.pa().nnz == 0 and t.transpose().shape == (len(s), len(o))
        assert t.sum().first()[0] == 0.0 and t.remove_empty().shape == (0, 0)
        assert t.merge(t).shape == t.shape
        with pytest.raises(TableError):
            t.reduce(lambda a, b: a + b)


def test_sums(example, zeros):
    assert pairs(example.sum("sample")) == {"S1": 3, "S2": 5, "S3": 7}
    assert pairs(example.sum("observation")) == {"O1": 3, "O2": 12}
    assert example.sum().first()[0] == 15
    assert pairs(zeros.sum("sample")) == {"a": 1, "b": -2, "c": 6, "d": 0}


def test_min_max(example, zeros):
    assert pairs(example.min("observation")) == {"O1": 1, "O2": 3} and example.max("whole").first()[0] == 5
    assert pairs(zeros.min("sample")) == {"a": 1, "b": -5, "c": 2, "d": None}
    with pytest.raises(Exception, match="no non-zero"):
        zeros.strict(zeros.max("sample")).collect()


def test_nonzero_counts(zeros):
    assert pairs(zeros.nonzero_counts("sample")) == {"a": 1, "b": 2, "c": 2, "d": 0}
    assert pairs(zeros.nonzero_counts("observation", binary=False)) == {"1": 3, "2": 7, "3": -5}
    assert zeros.nonzero_counts("whole").first()[0] == 5


def test_reduce(zeros):
    assert pairs(zeros.reduce(lambda a, b: a - b, "observation")) == {"1": -1, "2": -7, "3": 5}
    assert pairs(zeros.reduce(lambda a, b: a - b, "observation", column=True)) == {"1": -1, "2": -7, "3": 5}


def test_norm(spark, example, zeros):
    assert np.allclose(dense(example.norm("sample")), [[0, 1 / 5, 2 / 7], [1, 4 / 5, 5 / 7]])
    assert np.allclose(dense(example.norm("observation")), [[0, 1 / 3, 2 / 3], [3 / 12, 4 / 12, 5 / 12]])
    assert dense(example.norm("sample")) == dense(example.norm("sample", gather=True))
    cancelled = make(spark, [[1, 1], [-1, 1]], ["x", "y"], ["p", "q"]).norm("sample")
    assert dense(cancelled) == [[0, 0.5], [0, 0.5]]  # no shares where values add up to 0


def test_rankdata(spark):
    t = make(spark, [[99, 12, 8], [0, 42, 7], [112, 42, 6], [5, 75, 5]], list("abcd"), list("xyz"))
    assert dense(t.rankdata("sample")) == [[2, 1, 4], [0, 2.5, 3], [3, 2.5, 2], [1, 4, 1]]
    second = {m: [row[1] for row in dense(t.rankdata("sample", m))] for m in ("min", "max", "dense", "ordinal")}
    assert second == {"min": [1, 2, 2, 4], "max": [1, 3, 3, 4], "dense": [1, 2, 2, 3], "ordinal": [1, 2, 3, 4]}
    with pytest.raises(ValueError):
        t.rankdata(method="other")


def test_pa_and_transform(zeros):
    assert dense(zeros.pa()) == [[1, 0, 1, 0], [0, 1, 1, 0], [0, 1, 0, 0]]
    assert dense(zeros.transform(F.col("value") * 2)) == [[2, 0, 4, 0], [0, 6, 8, 0], [0, -10, 0, 0]]
    assert dense(zeros.transform(lambda v, i, m: np.where(v > 2, v, 0), "sample")) == [[0, 0, 0, 0], [0, 3, 4, 0], [0, 0, 0, 0]]
    assert dense(zeros.transform(lambda v, i, m: v.sum(), "observation")) == [[3, 0, 3, 0], [0, 7, 7, 0], [0, -5, 0, 0]]


def test_filters(example, zeros):
    assert ids(example.filter(["S1", "S3"])) == ["S1", "S3"]
    assert ids(example.filter(["S1", "S3"], invert=True)) == ["S2"]
    assert ids(example.filter(F.col("md.environment") == "A")) == ["S1", "S3"]
    assert ids(example.filter(F.col("total") > 4)) == ["S2", "S3"]
    assert ids(example.filter(F.col("total") > 4, invert=True)) == ["S1"]
    assert ids(example.filter(lambda v, i, m: m["environment"] == "A" and v[0] == 0)) == ["S1"]
    assert ids(example.filter(lambda v, i, m: v[0] == 0, invert=True)) == ["S2", "S3"]
    assert ids(zeros.filter(F.col("nnz") == 0)) == ["d"]
    assert ids(zeros.filter(F.col("least") > 0)) == ["a", "c"]  # a null test keeps nothing
    assert dense(example.filter(["O2"], "observation")) == [[3, 4, 5]]
    with pytest.raises(UnknownIDError):
        example.filter(["nope"])
    with pytest.raises(KeyError):
        example.filter(["nope"])
    with pytest.raises(TypeError):
        example.filter(3)


def test_remove_empty_and_head(zeros):
    kept = zeros.remove_empty()
    assert ids(kept) == ["a", "c"] and ids(kept, "observation") == ["1", "2"]
    assert ids(zeros.remove_empty("observation"), "observation") == ["1", "2"]
    assert dense(zeros.head(2, 3)) == [[1, 0, 2], [0, 3, 4]]
    with pytest.raises(IndexError):
        zeros.head(0, 1)


def test_lookups(example):
    assert example.value("O2", "S1") == 3 and example.value("O1", "S1") == 0
    assert example.exists("S1") and not example.exists("S9") and example.index("S3", "sample") == 2
    assert [r["value"] for r in example.data("S1").orderBy("ord").collect()] == [0, 3]
    assert [r["value"] for r in example.data("S1", dense=False).collect()] == [3]
    assert example[1, 2] == 5 and example[-1, 0] == 3
    assert [r["value"] for r in example[0, :].orderBy("ord").collect()] == [0, 1, 2]
    for bad in ((slice(0, 1), 0), (slice(None), slice(None)), (7, 0)):
        with pytest.raises(IndexError):
            example[bad]
    for call in (lambda: example.value("O9", "S1"), lambda: example.index("S9", "sample"), lambda: example.data("S9")):
        with pytest.raises(UnknownIDError):
            call()
    assert [(r[0], r[1]) for r in example.nonzero().collect()] == [("O1", "S2"), ("O1", "S3"), ("O2", "S1"), ("O2", "S2"), ("O2", "S3")]


def test_iteration(example):
    assert [(v.tolist(), i) for v, i, _ in example] == [([0, 3], "S1"), ([1, 4], "S2"), ([2, 5], "S3")]
    assert next(iter(example.iter("observation")))[2] == {"taxonomy": ["Bacteria", "Firmicutes"]}
    assert next(example.iter_data("sample", dense=False)) == [("O2", 3)]


def test_order_and_names(example):
    assert dense(example.transpose()) == [[0, 3], [1, 4], [2, 5]] and ids(example.transpose()) == ["O1", "O2"]
    assert ids(example.sort_order(["S3", "S1"])) == ["S3", "S1"]
    with pytest.raises(UnknownIDError):
        example.sort_order(["S3", "zz"])
    renamed = example.update_ids({"S1": "b10", "S2": "b9", "S3": "a1.5"})
    assert ids(renamed.sort()) == ["a1.5", "b9", "b10"] and dense(renamed.sort()) == [[2, 1, 0], [5, 4, 3]]
    assert ids(example.update_ids({"S1": "new"}, strict=False)) == ["new", "S2", "S3"]
    for mapping, strict, error in (({"S1": "x"}, True, TableError), ({"S1": "S2"}, False, TableError), ({}, False, ValueError)):
        with pytest.raises(error):
            example.update_ids(mapping, strict=strict)


def test_natural_order(spark):
    names = ["a10", "a2", "a1.5", "b", "a", "10", "9", "a2b3", "a2b10", "", "1e5", "007", "7"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(natural_key(F.col("x"))).collect()]
    assert got.index("9") < got.index("10") and got.index("a2b3") < got.index("a2b10") and got.index("a1.5") < got.index("a2") < got.index("a10")


def test_metadata(example):
    t = example.add_metadata({"S1": {"ph": 7, "environment": "C"}, "S9": {"ph": 1}})
    assert {r["id"]: r["md"]["ph"] for r in t.metadata().collect()} == {"S1": 7, "S2": None, "S3": None}
    assert {r["id"]: r["md"]["environment"] for r in t.metadata().collect()} == {"S1": "C", "S2": "B", "S3": "A"}
    assert not t.del_metadata(axis="sample").has_metadata("sample") and t.del_metadata(["ph"], "sample").samp.schema["md"].dataType.names == ["environment"]
    assert not example.del_metadata(["environment"], "sample").has_metadata("sample")
    columns = example.metadata_columns("observation")
    assert columns.columns == ["id", "taxonomy_0", "taxonomy_1"] and columns.first()["taxonomy_1"] == "Firmicutes"
    with pytest.raises(KeyError):
        example.del_metadata().metadata_columns("sample")
    g = example.add_group_metadata({"tree": ("newick", "(S1,S2);")})
    assert g.group_metadata() == {"tree": ("newick", "(S1,S2);")} and g.group_metadata("observation") == {}
    with pytest.raises(UnknownIDError):
        example.metadata("S9")


def test_merge(spark, example):
    a = make(spark, [[2, 0], [6, 1]], ["O1", "O2"], ["S1", "S2"])
    b = make(spark, [[4, 5], [0, 3], [10, 10]], ["O1", "O2", "O3"], ["S1", "S2"])
    m = a.merge(b)
    assert dense(m) == [[6, 5], [6, 4], [10, 10]] and m.props.type is None
    c = make(spark, [[1, 1]], ["O2"], ["S0", "S2"])
    assert ids(a.merge(c)) == ["S1", "S2", "S0"] and ids(a.merge(c, order="sorted")) == ["S0", "S1", "S2"]
    both = a.merge(c, sample="intersection", observation="intersection")
    assert dense(both) == [[2]] and ids(both) == ["S2"]
    assert dense(a.merge([b, c])) == [[6, 5, 0], [6, 5, 1], [10, 10, 0]]
    with pytest.raises(TableError):
        a.merge(make(spark, [[1]], ["zz"], ["S1"]), observation="intersection")
    with pytest.raises(ValueError):
        a.merge(b, sample="left")
    rich = example.merge(example)
    assert rich.obs.orderBy("ord").first()["md"]["taxonomy"] == ["Bacteria", "Firmicutes"]
    assert not example.merge(example, metadata=None).has_metadata("sample")
    cancelled = a.merge(a.transform(-F.col("value")))
    assert cancelled.nnz == 0 and cancelled.shape == (2, 2)


def test_merge_with_metadata_function(spark):
    a = make(spark, [[1]], ["x"], ["p"], samp_md=[{"k": "a"}])
    b = make(spark, [[1, 1]], ["x"], ["p", "q"], samp_md=[{"k": "b"}, {"k": "c"}])
    merged = a.merge(b, metadata=lambda mine, theirs: F.coalesce(theirs, mine))
    assert {r["id"]: r["md"]["k"] for r in merged.samp.collect()} == {"p": "b", "q": "c"}


def test_concat(spark):
    a = make(spark, [[1, 2]], ["O2"], ["s3", "s1"], obs_md=[{"t": "x"}])
    b = make(spark, [[3], [4]], ["O2", "O1"], ["s2"], obs_md=[{"t": "y"}, {"t": "z"}])
    t = a.concat([b])
    assert ids(t) == ["s3", "s1", "s2"] and ids(t, "observation") == ["O1", "O2"]
    assert dense(t) == [[0, 0, 4], [1, 2, 3]]
    assert {r["id"]: r["md"]["t"] for r in t.obs.collect()} == {"O1": "z", "O2": "x"}
    with pytest.raises(DisjointIDError):
        a.concat(a)
    assert dense(a.transpose().concat(b.transpose(), "observation")) == [[0, 1], [0, 2], [4, 3]]


def test_align(spark, example):
    other = example.sort_order(["S3", "S1", "S2"]).sort_order(["O2", "O1"], "observation")
    assert example.align_to(other).equals(other)
    assert ids(example.align_to(other, "sample")) == ["S3", "S1", "S2"]
    with pytest.raises(DisjointIDError):
        example.align_to(example.filter(["S1"]), "sample")
    with pytest.raises(TableError):
        example.align_to(make(spark, [[1]], ["zz"], ["yy"]))
    md = spark.createDataFrame([("S3", 1), ("S1", 2), ("zz", 3)], "id string, n int")
    table, frame = example.align_to_frame(md)
    assert ids(table) == ["S1", "S3"] and [r["n"] for r in frame.collect()] == [2, 1]
    table, tips = example.align_tree("((O2:0.1,'O 3':2)n1:1,(O1[note],O9));")
    assert tips == ["O2", "O1"] and ids(table, "observation") == ["O2", "O1"]
    assert newick_tips("(a,(b:1,c)d,e)f;") == ["a", "b", "c", "e"]


def test_partition(example):
    parts = dict(example.partition(F.col("md.environment")))
    assert list(parts) == ["A", "B"] and ids(parts["A"]) == ["S1", "S3"] and dense(parts["B"]) == [[1], [4]]
    by_list = dict(example.partition({"x": ["S1"], "y": ["S2"]}))
    assert set(by_list) == {"x", "y", None}
    assert set(dict(example.partition({"S1": "x", "S2": "y"}, ignore_none=True))) == {"x", "y"}
    by_call = dict(example.partition(lambda i, m: m["environment"].lower()))
    assert ids(by_call["a"]) == ["S1", "S3"]
    assert ids(dict(example.partition({"S1": "x"}, remove_empty=True))["x"], "observation") == ["O2"]
    sizes = {r["label"]: (r["members"], r["total"]) for r in example.partition_sizes(F.col("md.environment")).collect()}
    assert sizes == {"A": (2, 10), "B": (1, 5)}
    with pytest.raises(ValueError):
        list(example.partition({"S1": 3}))


def test_collapse(spark, example):
    t = example.collapse(F.col("md.environment"), norm=False)
    assert ids(t) == ["A", "B"] and dense(t) == [[2, 1], [8, 4]]
    assert dense(example.collapse(F.col("md.environment"))) == [[1, 1], [4, 4]]
    assert [r["md"]["collapsed_ids"] for r in t.samp.orderBy("ord").collect()] == [["S1", "S3"], ["S2"]]
    assert ids(example.collapse(F.col("md.environment"), min_group_size=2)) == ["A"]
    wide = make(spark, [[1, 4, 6], [0, 0, 9], [2.5, 1, 1]], ["a", "b", "c"], ["x", "y", "z"])
    label = F.when(F.col("id") < "c", "g").otherwise("h")
    for how in ("median", np.median):
        assert dense(wide.collapse(label, "observation", how=how, norm=False)) == [[0.5, 2, 7.5], [2.5, 1, 1]]
    assert dense(wide.collapse(label, "observation", how=F.median, norm=False, nonzeros=True)) == [[1, 4, 7.5], [2.5, 1, 1]]
    assert dense(wide.collapse(label, "observation", how="max", norm=False)) == [[1, 4, 9], [2.5, 1, 1]]
    assert dense(wide.collapse(label, "observation", how="percentile:0.25", norm=False)) == [[0.25, 1, 6.75], [2.5, 1, 1]]
    below = make(spark, [[-1, 4], [0, 0], [-3, 0]], ["a", "b", "c"], ["x", "y"])
    for how, expected in (("median", [-1, 0]), ("min", [-3, 0]), ("max", [0, 4]), ("mean", [-4 / 3, 4 / 3]), ("count", [2, 1]), (lambda v: v[0] + 10 * v[2], [-31, 4])):
        assert dense(below.collapse(F.lit("g"), "observation", how=how, norm=False)) == [pytest.approx(expected)]
    # zeros do not give zero, so vectors without cells have a value too
    assert dense(make(spark, [[0, 4], [0, 0]], ["a", "b"], ["x", "y"]).collapse(F.lit("g"), "observation", how=lambda v: (v == 0).sum(), norm=False)) == [[2, 1]]
    with pytest.raises(ValueError):
        wide.collapse(label, "observation", how="mode")
    # members without cells count in the divisor
    sparse = make(spark, [[4, 0], [0, 0]], ["a", "b"], ["x", "y"])
    assert dense(sparse.collapse(F.lit("g"), "observation")) == [[2, 0]]


PATHS = [{"pathways": [["a", "bx"], ["a", "d"]]}, {"pathways": [["a", "bx"]]}, {"pathways": [["a"]]}]


def test_collapse_one_to_many(spark):
    t = make(spark, [[5, 1], [2, 0], [7, 7]], ["1", "2", "3"], ["x", "y"], PATHS)
    bins = F.transform("md.pathways", lambda p: F.struct(F.array_join(p, "; ").alias("path"), F.get(p, F.lit(1)).alias("bin")))
    added = t.collapse_one_to_many(bins)
    assert ids(added, "observation") == ["bx", "d"] and dense(added) == [[7, 1], [5, 1]]
    assert added.obs.orderBy("ord").first()["md"]["Path"] == "a; bx"
    assert dense(t.collapse_one_to_many(bins, mode="divide")) == [[4.5, 0.5], [2.5, 0.5]]

    def walk(i, m):
        for p in m["pathways"]:
            yield p, p[1]

    assert dense(t.collapse_one_to_many(walk)) == [[7, 1], [5, 1]]
    for strict in (bins, walk):
        with pytest.raises(Exception):
            t.collapse_one_to_many(strict, strict=True).cells.collect()
    with pytest.raises(ValueError):
        t.collapse_one_to_many(bins, mode="mean")


def test_collapse_levels(spark):
    t = make(spark, [[1, 2], [3, 0]], ["1", "2"], ["x", "y"], [{"tax": ["B", "F"]}, {"tax": ["B", "G"]}])
    rows = {(r["path"], r["samp_id"]): r["value"] for r in t.collapse_levels(F.col("md.tax")).collect()}
    assert rows == {("B", "x"): 4, ("B", "y"): 2, ("B; F", "x"): 1, ("B; F", "y"): 2, ("B; G", "x"): 3}


def test_pairwise(example):
    assert sorted(map(tuple, example.pairwise_ids().collect())) == [("S1", "S2"), ("S1", "S3"), ("S2", "S3")]
    assert example.pairwise_ids(tri=True, diag=True).count() == 6 and example.pairwise_ids(tri=False).count() == 6 and example.pairwise_ids(tri=False, diag=True).count() == 9
    vectors = {(r["i"], r["j"]): (r["values_i"], r["values_j"]) for r in example.iter_pairwise().collect()}
    assert vectors["S1", "S3"] == ([0, 3], [2, 5])
    assert {(r["i"], r["j"]): (r["dot"], r["shared"]) for r in example.pairwise_dot().collect()} == {("S1", "S2"): (12, 1), ("S1", "S3"): (15, 1), ("S2", "S3"): (22, 2)}


def test_subsample(spark):
    t = make(spark, [[5, 0, 2], [20, 3, 2.9], [0, 40, 0]], ["a", "b", "c"], ["x", "y", "z"])
    for method in (t.subsample, t.subsample_by_hash):
        s = method(10, seed=1)
        assert set(ids(s)) == {"x", "y"} and set(pairs(s.sum("sample")).values()) == {10}
        before = {(r[0], r[1]): r[2] for r in t.cells.collect()}
        assert all(r[2] <= before[r[0], r[1]] for r in s.cells.collect())
    again = MatrixTable(t.cells.repartition(7, "obs_id"), t.obs, t.samp)
    assert sorted(t.subsample(10, seed=1).cells.collect()) == sorted(again.subsample(10, seed=1).cells.collect())
    assert sorted(t.subsample_by_hash(10, seed=1).cells.collect()) == sorted(again.subsample_by_hash(10, seed=1).cells.collect())
    assert set(pairs(t.subsample(30, with_replacement=True, seed=2).sum("sample")).values()) == {30}
    assert t.subsample(2, by_id=True).length() == 2 and t.subsample(0).nnz == 0
    endless = t.subsamples(2, by_id=True)
    assert [next(endless).length() for _ in range(2)] == [2, 2]
    for bad in ({"n": -1}, {"n": 1, "by_id": True, "with_replacement": True}):
        with pytest.raises(ValueError):
            t.subsample(**bad)


def test_subsample_is_unbiased(spark):
    t = make(spark, [[8], [2]], ["a", "b"], ["x"])
    got = [pairs(t.subsample(5, seed=k).sum("observation")).get("a", 0) for k in range(12)]
    assert 3 <= np.mean(got) <= 5


def test_summary(example, zeros):
    s = zeros.summary().first()
    assert (s["mn"], s["mx"], s["med"], s["mean"], s["total"]) == (-2, 6, 0.5, 1.25, 5) and s["sd"] == pytest.approx(np.std([1, -2, 6, 0]))
    text = example.summary_text()
    assert "Num samples: 3" in text and "Total count: 15" in text and text.endswith("S1: 3.000\nS2: 5.000\nS3: 7.000")
    assert "environment" in text and "Table density (fraction of non-zero values): 0.833" in text
    assert "S1: 1.000" in example.summary_text(qualitative=True) and "O2: 12.000" in example.summary_text(axis="observation")


def test_equality(example):
    assert example == example.copy() and example.differences(example) == ""
    assert example.differences(example._new(type="x")) == "type"
    assert example.differences(example.sort_order(["S2", "S1", "S3"])) == "sample ids"
    assert example.differences(example.head(1, 3)) == "observation ids"
    assert example.differences(example.del_metadata(axis="observation")) == "observation metadata"
    assert example.differences(example.pa()) == "cells" and example != example.pa()


def test_checks(spark, example):
    broken = MatrixTable(example.cells, example.obs.where("id = 'O1'"), example.samp)
    with pytest.raises(TableError, match="not on the axis"):
        broken.validate()
    with errstate(all="ignore"):
        broken.validate()
    with pytest.raises(TableError):
        broken.validate("obssize")


def test_invariants(example):
    """Parts put together again are the table; a collapse sums what its partition sums."""
    parts = [t for _, t in example.partition(F.col("md.environment"))]
    again = parts[0].concat(parts[1:]).sort_order(["S1", "S2", "S3"]).sort_order(["O1", "O2"], "observation")
    assert dense(again) == dense(example)
    assert {r["label"]: r["total"] for r in example.partition_sizes(F.col("md.environment")).collect()} == pairs(example.collapse(F.col("md.environment"), norm=False).sum("sample"))


def test_numbering_in_parts(spark, monkeypatch):
    """Many ids are numbered in parts like few in one task."""
    monkeypatch.setattr(core, "ONE_TASK", 40)
    monkeypatch.setattr(core, "FEW_BYTES", 0)
    df = spark.range(500).selectExpr("concat('k', id * 7919 % 1009) AS id", "id AS v")
    got = {r["id"]: r["ord"] for r in core.renumbered(df, "id").collect()}
    assert got == {x: i for i, x in enumerate(sorted(got))} and len(got) == 500
    assert core.renumbered(df, "id").columns == ["id", "v", "ord"]
    assert [r["ord"] for r in core.renumbered(df.limit(0), "id").collect()] == []


def test_dense_vectors_in_steps(spark, example, monkeypatch):
    monkeypatch.setattr(axis, "VALUES_AT_ONCE", 1)
    rows = {r["id"]: list(r["values"]) for r in example.vectors("sample").collect()}
    table = dense(example)
    assert rows == {s: [row[i] for row in table] for i, s in enumerate(ids(example))}


def test_mapped_vectors(spark, data, monkeypatch):
    """A function gets every dense vector, but none leaves its task."""
    table = [[0, 1, 2], [0, 0, -5.5]]
    t = make(spark, table, ["O1", "O2"], ["a", "b", "c"])
    wanted = {a: {i: list(map(float, v)) for i, v in zip(names, rows, strict=True)} for a, names, rows in (("sample", "abc", zip(*table, strict=True)), ("observation", ["O1", "O2"], table))}
    monkeypatch.setattr(type(t), "vectors", None)
    for a in ("sample", "observation"):
        got = t.map_vectors(lambda v: (v.tolist(), len(v)), "v array<double>, n int", a)
        assert got.columns == ["id", "v", "n"] and {r["id"]: list(r["v"]) for r in got.collect()} == wanted[a]
    assert [f.name for f in surface.vectors_dense(spark, data).schema] == ["id", "length", "total", "nonzeros"]
    stats = {r["id"]: (r["total"], r["nnz"]) for r in matrix.sales(spark, data).vector_stats("sample").collect()}
    parts = spark.read.parquet(f"{data}/part.parquet").count()
    got = surface.vectors_dense(spark, data).collect()
    assert {r["id"]: (r["total"], r["nonzeros"]) for r in got} == stats and {r["length"] for r in got} == {parts}


def test_many_values(spark, example):
    keys = spark.createDataFrame([("O1", "S1"), ("O1", "S1"), ("O2", "S1"), ("zz", "S1"), ("O1", "zz")], "obs_id string, samp_id string")
    got = {(r["obs_id"], r["samp_id"]): r["value"] for r in example.values(keys).collect()}
    assert got == {("O1", "S1"): example.value("O1", "S1"), ("O2", "S1"): example.value("O2", "S1"), ("zz", "S1"): None, ("O1", "zz"): None}


def test_sort_with(example):
    assert ids(example.sort_with(lambda x: sorted(x, reverse=True))) == ["S3", "S2", "S1"]


def test_dicts_and_sparse_vectors():
    triples = core._triples
    assert triples([{(0, 0): 1, (0, 2): 5}, {(0, 1): 2}], False, 2, 3) == [(0, 0, 1), (0, 2, 5), (1, 1, 2)]  # rows
    assert triples([{(0, 0): 1}, {(1, 0): 2}, {}], False, 2, 3) == [(0, 0, 1), (1, 1, 2)]  # columns
    assert triples([{(0, 0): 1, (0, 1): 3}, {}], False, 2, 2) == [(0, 0, 1), (0, 1, 3)]
    assert triples([{(0, 0): 1, (1, 0): 3}, {(1, 0): 2}], False, 2, 2) == [(0, 0, 1), (1, 0, 3), (1, 1, 2)]

    class Coo:
        row, col, data = np.array([0, 1]), np.array([2, 0]), np.array([4, 5])

        def tocoo(self):
            return self

    assert triples(Coo(), False, 2, 3) == [(0, 2, 4), (1, 0, 5)]
    assert triples([Coo(), Coo()], False, 2, 3) == [(0, 2, 4), (0, 0, 5), (1, 2, 4), (1, 0, 5)]


def test_reduce_makes_no_dense_vectors(spark, monkeypatch):
    """A fold is that over the dense vectors, with zeros before, between and behind, but for their making."""
    rows = [[0, 0, -3, 0, 0, 0, 2, 0, 0], [5, 0, 0, 0, 0, 0, 0, 0, -1], [0] * 9, [-1, -2, -3, -4, -5, -6, -7, -8, -9]]
    t = make(spark, rows, list("abcd"), [f"s{i}" for i in range(9)])
    monkeypatch.setattr(type(t), "vectors", None)
    folds = [(lambda a, b: max(a, b), F.greatest), (lambda a, b: b - a, lambda a, b: b - a), (lambda a, b: a / 2 + b + 1, lambda a, b: a / 2 + b + 1)]
    for f, column in folds:
        for axis, vectors in (("observation", rows), ("sample", [list(x) for x in zip(*rows, strict=True)])):
            wanted = [reduce(f, map(float, v)) for v in vectors]
            names = list("abcd") if axis == "observation" else [f"s{i}" for i in range(9)]
            assert pairs(t.reduce(f, axis)) == pairs(t.reduce(column, axis, column=True)) == dict(zip(names, wanted, strict=True))

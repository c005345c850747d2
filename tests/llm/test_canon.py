import unicodedata
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrix.llm import canon
from sparrix.llm.canon import canonical_array, canonical_text, look_alike_pairs, look_classes


def one(text):
    return canonical_array(pa.array([text], pa.string())).to_pylist()[0]


SAME = [
    ("ＡＢＣ１２３！", "ABC123!"), ("ｶﾞｷﾞ", "ガギ"), ("café", "café"), ("ệ", "ệ"), ("ệ", "ệ"), ("zero​width﻿", "zerowidth"), ("so­ft", "soft"),
    ("a b c　d", "a b c d"), ("well‐known‑x", "well-known-x"), ("ﬁn ﬂy eﬀ ﬃ ﬆ", "fin fly eff ffi st"), ("раураl", "paypal"), ("ΑΒΕ", "ABE"), ("Ⅷ ⅳ", "VIII iv"),
    ("gɡ", "gg"), ("ё", "ë"), ("한글", unicodedata.normalize("NFD", "한글")), ("a\r\nb\rc d", "a\nb\nc\nd"), ("へ", "ヘ"), ("ӏ", "l"), ("́x", "́x"), ("x️", "x"),
]
DIFFERENT = ["x²", "x2", "x₂", "x②", "½", "1/2", "a", "á", "A", "l", "1", "O", "0", "a-b", "ab", "a b", "a  b", "a\nb", "…", "...", "ß", "ss", "ſ", "s", "–", "-"]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert one(a) == one(b)


def test_different():
    forms = [one(x) for x in DIFFERENT]
    assert len(set(forms)) == len(DIFFERENT)


def test_batches_nulls_and_slices():
    texts = ["", None, "​", "é", "x" * 3_000_000, "日本", None, "́", "á" * 5]
    array = pa.array(texts, pa.string())
    out = canonical_array(array).to_pylist()
    assert out == ["", None, "", "é", texts[4], "日本", None, "́", "á" * 5]
    assert canonical_array(array.slice(3, 3)).to_pylist() == out[3:6] and canonical_array(pa.array([], pa.string())).to_pylist() == []
    assert canonical_array(pa.array([None], pa.string())).to_pylist() == [None]


ALPHABET = "aeoсеАｅ̧̣́̂​  \r\nﬁがｶﾞ각각②-‐ё"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), max_size=5))
def test_fixed_point_and_batch_independence(texts):
    out = canonical_array(pa.array(texts, pa.string())).to_pylist()
    assert out == [one(t) for t in texts]
    assert [one(t) for t in out] == out
    assert out == [one(unicodedata.normalize("NFD", t)) for t in texts] == [one(unicodedata.normalize("NFC", t)) for t in texts]
    assert all(unicodedata.is_normalized("NFC", t) for t in out)


def test_many_marks():
    text = "a" + "̣́" * 300
    assert one(text) == one(unicodedata.normalize("NFC", text))


TEXTS = [("ab", 1), ("аb", 2), ("ab", 3), ("аb", 4), ("a​b", 5), ("other", 6), ("other", 7), (None, 8), ("", 9), ("", 10), ("​", 11), ("﻿", 12), ("ab", 1), ("ab", None)]


def test_pairs(spark):
    df = spark.createDataFrame([(t, d, "x", "y") for t, d in TEXTS], "text string, doc_id long, same string, raw string")
    got = [tuple(r) for r in look_alike_pairs(df).collect()]
    known = {(d, t) for t, d in TEXTS if t and d is not None}
    expected = {(a, b) for (a, x), (b, y) in combinations(sorted(known), 2) if x != y and one(x) == one(y)}
    assert set(got) == expected and len(got) == len(expected) and (11, 12) in expected
    classes = {r["doc_id"]: (r["class_id"], r["size"], r["forms"]) for r in look_classes(df).collect()}
    assert classes[4] == (1, 5, 3) and classes[7] == (6, 2, 1) and set(classes) == {1, 2, 3, 4, 5, 6, 7, 11, 12}
    assert look_alike_pairs(df.limit(0)).count() == 0
    assert df.select(canonical_text("text").alias("c")).where("c is null").count() == 1


def test_split_forms_and_classes(spark, monkeypatch):
    """Parts of forms and of their documents give the same pairs."""
    monkeypatch.setattr(canon, "PART_DOCS", 3)
    monkeypatch.setattr(canon, "PART_FORMS", 2)
    texts = ["ab"] * 10 + ["аb"] * 7 + ["a\u200bb", "ａb", "ａ\u200bb", "аｂ"] + ["cd"] * 5 + ["ａb"]
    df = spark.createDataFrame([(t, d) for d, t in enumerate(texts)], "text string, doc_id long")
    got = [tuple(r) for r in look_alike_pairs(df).collect()]
    expected = {(a, b) for (a, x), (b, y) in combinations(enumerate(texts), 2) if x != y and one(x) == one(y)}
    assert set(got) == expected and len(got) == len(expected)


def test_many_copies_of_one_form(spark):
    """Copies are not compared with each other: 100,000 of them and one variant."""
    df = spark.range(100_000).selectExpr("id as doc_id", "'stock reply' as text").unionByName(spark.createDataFrame([(-1, "stock reply\u200b")], "doc_id long, text string"))
    pairs = look_alike_pairs(df)
    assert pairs.count() == 100_000 and pairs.where("doc_a <> -1").count() == 0


def test_document_with_two_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "a\u200bb"), (2, "аb")], "doc_id long, text string")
    assert [tuple(r) for r in look_alike_pairs(df).collect()] == [(1, 2)]


def test_tables_are_made_by_rule():
    t = canon.tables()
    assert len(t["keys"]) > 11_000 and (t["length"] == 0).sum() > 100

"""One common form for texts that look the same but are stored in other characters.

A batch of Arrow strings becomes one array of code points. A lookup table gives each code
point its expansion, the expansions are gathered by offsets, and marks are put in order
and composed for all texts of the batch at once; no text is handled by itself.

What does not count is dissolved: full and half width forms, how accents are stored,
characters that show nothing, the kind of a blank or hyphen, joined letter forms and
letters of another script with the same shape. Raised, lowered, circled and fraction
signs, case, accents, digits, punctuation and line breaks are kept.

Edge cases: a null text stays null, an empty one empty; a text of characters that show
nothing becomes empty; CR LF, a lone CR and the Unicode line and paragraph separators are
one line break each; marks at the start of a text stay there; the result is a fixed point.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.runtime import materialize

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 1 << 20
#: Documents of a stored form, and stored forms of a class, that are joined at once, about.
PART_DOCS, PART_FORMS = 1000, 1000

# Letters and the letter of the Latin script (in Japanese, of Katakana) that
# has their shape. Each string holds pairs: the letter, then the one it looks like.
LOOKALIKES = {
    "Cyrillic small": "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl ԍɡ ӕæ әə ԑɛ",
    "Cyrillic capital": "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ѴV ҮY ԌG ӔÆ ӀI",
    "Greek small": "οo νv ϲc ϳj ιi αa ρp υu",
    "Greek capital": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ",
    "Armenian": "օo ոn սu հh յj ցg ՕO ՏS ԼL",
    "Cherokee": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
    "Latin": "ɡg ɑa",
    "Hiragana": "へヘ べベ ぺペ",
}
#: Hyphens that differ from U+002D in kind only.
HYPHENS = "‐‑﹣－"
#: Compatibility decompositions that keep the shape, by their tag; the tag <compat> is
#: taken for letters and letter numbers only.
KEPT_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Letters whose <compat> decomposition looks different.
OTHER_SHAPE = "ſϐϑϒϓϔϕϖϰϱϴϵĿŀŉ"
LAST = 0x110000


def _is_blank(c: str) -> bool:
    return unicodedata.category(c) == "Zs" or c == "\u2800"


def _shows_nothing(cp: int, category: str) -> bool:
    if category == "Cf":  # all but the number and verse signs that stand around digits
        return not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x8E2, 0x110BD, 0x110CD))
    if category == "Cc":
        return chr(cp) not in "\t\n\v\f\r\x85"
    return cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D, 0x180F) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made by rule from the Unicode database."""
    alike = {pair[0]: pair[1:] for row in LOOKALIKES.values() for pair in row.split()}

    def expand(c: str) -> str:
        cp, category = ord(c), unicodedata.category(c)
        if _shows_nothing(cp, category):
            return ""
        if _is_blank(c):
            return " "
        if c in HYPHENS:
            return "-"
        if c in "\r\x85\u2028\u2029":
            return "\n"
        tag, *rest = unicodedata.decomposition(c).split() or [""]
        if tag and tag[0] != "<":
            rest, tag = [tag, *rest], ""
        whole = "".join(chr(int(x, 16)) for x in rest)
        if 0xAC00 <= cp <= 0xD7A3:
            return c
        if rest and not tag or tag in KEPT_TAGS or tag == "<compat>" and category[0] in "LN" and category != "No" and whole[0] != " " and c not in OTHER_SHAPE:
            return "".join(map(expand, whole))
        return expand(alike[c]) if c in alike else c

    start = np.arange(LAST, dtype=np.int32)
    length = np.ones(LAST, np.uint8)
    mark = np.zeros(LAST, np.uint8)
    second = np.zeros(LAST, bool)
    more: list[int] = []
    composed: dict[int, int] = {}
    for cp in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= cp < 0xE000 or 0x3400 < cp < 0xA000:
            continue
        c = chr(cp)
        mark[cp] = unicodedata.combining(c)
        x = expand(c)
        if x != c:
            start[cp], length[cp] = LAST + len(more), len(x)
            more += map(ord, x)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            composed[int(parts[0], 16) * LAST + int(parts[1], 16)] = cp
    for cp in range(0xAC00, 0xD7A4):  # Hangul: lead and vowel, then that and tail
        s = cp - 0xAC00
        pair = (0xAC00 + s // 28 * 28, 0x11A7 + s % 28) if s % 28 else (0x1100 + s // 588, 0x1161 + s % 588 // 28)
        composed[pair[0] * LAST + pair[1]] = cp
    keys = np.array(sorted(composed), np.int64)
    for k in keys % LAST:
        second[k] = mark[k] == 0
    return {
        "start": start, "length": length, "flat": np.concatenate((np.arange(LAST, dtype=np.uint32), np.array(more, np.uint32))), "mark": mark,
        "second": second, "keys": keys, "values": np.array([composed[k] for k in keys.tolist()], np.uint32),
    }


def _composite(t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What each pair of code points composes to, or 0."""
    key = a.astype(np.int64) * LAST + b
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    return np.where(t["keys"][at] == key, t["values"][at], 0)


def _compose(t: dict[str, np.ndarray], cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    while t["second"][cp].any():  # pairs of two full characters
        i = np.flatnonzero(t["second"][cp[1:]] & (row[1:] == row[:-1]))
        made = _composite(t, cp[i], cp[i + 1])
        i, made = i[made > 0], made[made > 0]
        if not len(i):
            break
        clash = np.concatenate(([False], i[1:] == i[:-1] + 1))  # the left one of two that overlap goes first
        i, made = i[~clash], made[~clash]
        cp[i] = made
        keep = np.ones(len(cp), bool)
        keep[i + 1] = False
        cp, row = cp[keep], row[keep]
    mark = t["mark"][cp]
    if not mark.any():
        return cp, row
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    base = (mark == 0) | new_row
    segment = np.cumsum(base)
    if ((mark[1:] < mark[:-1]) & (mark[1:] > 0) & ~new_row[1:]).any():
        # a mark at the start of a text heads its segment but is sorted like the others
        order = np.lexsort((mark, segment))
        cp, mark, segment = cp[order], mark[order], segment[order]
        base = np.concatenate(([True], segment[1:] != segment[:-1]))
    head = np.flatnonzero(base)[segment - 1]
    ordinal = np.arange(len(cp)) - head
    at = np.flatnonzero(ordinal > 0)
    at = at[np.argsort(ordinal[at], kind="stable")]
    bounds = np.searchsorted(ordinal[at], np.arange(1, ordinal.max() + 2))
    gone = np.zeros(len(cp), bool)
    last = np.zeros(len(cp), np.uint8)  # class of the last mark left standing behind a base
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        i = at[lo:hi]
        h = head[i]
        made = np.where((mark[h] == 0) & ((last[h] == 0) | (last[h] < mark[i])), _composite(t, cp[h], cp[i]), 0)
        hit = made > 0
        cp[h[hit]] = made[hit]
        gone[i[hit]] = True
        last[h[~hit]] = mark[i[~hit]]
    return cp[~gone], row[~gone]


def canonical_array(texts: pa.Array) -> pa.Array:
    """The common form of each string of an Arrow array."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    pieces, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES_AT_ONCE, side="right")) - 1)
        pieces.append(_canonical_piece(texts, offsets[lo : hi + 1]))
        lo = hi
    out = pa.concat_arrays(pieces)
    return pa.compute.if_else(texts.is_null(), pa.scalar(None, pa.string()), out)


def _canonical_piece(texts: pa.Array, offsets: np.ndarray) -> pa.Array:
    t = tables()
    n = len(offsets) - 1
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    if not len(data):
        return pa.array([""] * n, pa.string())
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets - offsets[0]]
    cp = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    crlf = np.flatnonzero((cp[:-1] == 13) & (cp[1:] == 10) & (row[:-1] == row[1:]))
    if len(crlf):
        keep = np.ones(len(cp), bool)
        keep[crlf] = False
        cp, row = cp[keep], row[keep]
    length = t["length"][cp].astype(np.int64)
    if (length == 1).all():
        cp = t["flat"][t["start"][cp]]
    else:
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        cp, row = t["flat"][np.repeat(t["start"][cp], length) + within], np.repeat(row, length)
    if len(cp):
        cp, row = _compose(t, cp.copy(), row)
    size = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, size, minlength=n)))).astype(np.int32)
    encoded = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(encoded))


@F.arrow_udf(T.StringType())
def canonical_text(texts: pa.Array) -> pa.Array:
    """Column function: the common form of a text."""
    return canonical_array(texts)


def _keys(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, same, raw)``: digests of the common form and of the text as stored."""
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc).isNotNull())
    return rows.select(F.col(doc).alias("doc"), F.unhex(F.sha2(canonical_text(F.col(text)), 256)).alias("same"), F.unhex(F.sha2(F.col(text), 256)).alias("raw")).distinct()


def _part(c: str, rows: str, size: int) -> Column:
    """One of the parts into which ``rows`` rows are split by hash, of about ``size`` rows each."""
    return F.pmod(F.xxhash64(c), F.ceil(F.col(rows) / size)).cast("int")


def _parts(rows: str, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(rows) / size).cast("int") - 1))


def look_alike_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``, doc_a < doc_b: texts that look the same and are stored differently.

    Null and empty texts are in no pair. Stored forms are paired first, then expanded to
    their documents, so plain copies of one form are never compared. A class of many forms
    and a form of many documents are split into parts, which are joined part by part: a
    task holds a part of each of two forms, and makes only rows of the result.
    """
    keys = materialize(_keys(docs, doc, text), "looks")
    forms = keys.groupBy("same", "raw").agg(F.count("*").alias("docs"))
    several = forms.groupBy("same").agg(F.count("*").alias("forms")).where("forms > 1")
    forms = materialize(forms.join(several, "same"), "forms")
    variants = keys.join(forms.select("raw", "docs"), "raw").select("raw", "doc", _part("doc", "docs", PART_DOCS).alias("part"))
    blocks = materialize(variants.groupBy("raw", "part").agg(F.collect_list("doc").alias("ids")), "blocks")
    a = forms.select("same", F.col("raw").alias("raw_a"), F.col("docs").alias("docs_a"), _part("raw", "forms", PART_FORMS).alias("f"))
    b = forms.select("same", F.col("raw").alias("raw_b"), F.col("docs").alias("docs_b"), _parts("forms", PART_FORMS).alias("f"))
    pairs = a.join(b, ["same", "f"]).where("raw_a < raw_b").select("raw_a", "docs_a", "raw_b", "docs_b")
    pairs = pairs.select("*", _parts("docs_a", PART_DOCS).alias("part_a")).select("*", _parts("docs_b", PART_DOCS).alias("part_b"))
    for side in "ab":
        pairs = pairs.join(blocks.select(F.col("raw").alias(f"raw_{side}"), F.col("part").alias(f"part_{side}"), F.col("ids").alias(f"ids_{side}")), [f"raw_{side}", f"part_{side}"])
    found = pairs.select(F.explode("ids_a").alias("x"), "ids_b").select("x", F.explode("ids_b").alias("y"))
    # a document that came with two texts is no pair, and may give one twice
    return found.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def look_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, class_id, size, forms)``: one row for each text that is neither null nor empty.

    The class is named by its least document; ``forms`` counts its stored forms.
    """
    keys = materialize(_keys(docs, doc, text), "looks")
    forms = keys.groupBy("same", "raw").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    sizes = forms.groupBy("same").agg(F.min("least").alias("class_id"), F.sum("n").alias("size"), F.count("*").alias("forms"))
    return keys.join(sizes, "same").select(F.col("doc").alias(doc), "class_id", "size", "forms")

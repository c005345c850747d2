"""Several values packed in one field, split by delimiter skeletons.

A field is cut into segments: runs of ordinary characters and single special ones
(delimiters, quotes, backslashes, brackets, blanks). Masking each run by one letter gives
the field's skeleton. Fields are many, skeletons are few; only each distinct skeleton is
resolved, to the numbers of the segments that make up each value. The rules are joined to
the fields by skeleton and applied by position, all within the JVM.

Rules: values are separated by any delimiter outside quotes and not behind a backslash. A
quote opens a quoted value only as the first sign of a value; within, a doubled quote, or
a backslash and the quote, stand for the quote. Quotes or brackets around the whole field
only wrap it. Outer blanks, enclosing quotes and escapes are no part of a value.

Edge cases: a null or blank field gives no row; an empty place gives no row but counts;
a quote that is never closed and a backslash at the end are ordinary signs; what stands
between a closing quote and the next delimiter belongs to the value; a backslash before
an ordinary sign is ordinary; repeated rows give repeated values.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrix.runtime import materialize

DELIMITERS = ";|,\t>"
QUOTES = "\"'"
BLANKS = " \u00a0\u2007\u202f\u3000\r\n\x0b\x0c"
#: Rules are broadcast up to this number of characters, beyond it they are shuffled.
BROADCAST_CHARS = 8_000_000
#: Parts into which the fields of one skeleton are divided where rules are shuffled.
PARTS = 32
MASK = "a"


def _specials(delimiters: str) -> str:
    return delimiters + QUOTES + "\\[]" + BLANKS + "\t"


def _class(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in dict.fromkeys(chars))


def resolve(skeleton: str, delimiters: str = DELIMITERS) -> list[tuple[int, list[int]]]:
    """The places that hold a value, each with the numbers of its value's segments."""
    lo, hi = _trimmed(skeleton, 0, len(skeleton))
    drop: set[int] = set()
    while hi - lo >= 2:  # wrappings around the whole field, possibly several
        first = skeleton[lo]
        if first == "[" and _bracket(skeleton, lo, hi) == hi - 1:
            lo, hi = _trimmed(skeleton, lo + 1, hi - 1)
        elif first in QUOTES and _closing(skeleton, lo, hi, first) == hi - 1:
            signs = [i for i in range(lo + 1, hi - 1) if i not in drop]
            k = 0
            while k + 1 < len(signs):  # a pair stands for the quote
                pair = skeleton[signs[k + 1]] == first and skeleton[signs[k]] in ("\\", first)
                drop |= {signs[k]} if pair else set()
                k += 1 + pair
            lo, hi = _trimmed(skeleton, lo + 1, hi - 1)
        else:
            break
    kept = [i for i in range(lo, hi) if i not in drop]
    return _split(skeleton, kept, delimiters)


def _trimmed(skeleton: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and skeleton[lo] in BLANKS + "\t":
        lo += 1
    while hi > lo and skeleton[hi - 1] in BLANKS + "\t":
        hi -= 1
    return lo, hi


def _bracket(skeleton: str, lo: int, hi: int) -> int:
    """Where the bracket opened at ``lo`` is closed, or -1."""
    depth = 0
    for i in range(lo, hi):
        depth += (skeleton[i] == "[") - (skeleton[i] == "]")
        if not depth:
            return i
    return -1


def _closing(skeleton: str, lo: int, hi: int, quote: str) -> int:
    """Where the quote opened at ``lo`` is closed, or -1."""
    i = lo + 1
    while i < hi:
        if skeleton[i] == "\\" and i + 1 < hi and skeleton[i + 1] == quote:
            i += 2
        elif skeleton[i] == quote:
            if i + 1 < hi and skeleton[i + 1] == quote:
                i += 2
            else:
                return i
        else:
            i += 1
    return -1


def _split(skeleton: str, kept: list[int], delimiters: str) -> list[tuple[int, list[int]]]:
    text = "".join(skeleton[i] for i in kept)
    out: list[tuple[int, list[int]]] = []
    place, i = 0, 0
    while True:
        value: list[int] = []
        while i < len(text) and text[i] in BLANKS + "\t" and text[i] not in delimiters:
            i += 1
        if i < len(text) and text[i] in QUOTES and (end := _closing(text, i, len(text), text[i])) > 0:
            quote, i = text[i], i + 1
            while i < end:
                if text[i] in ("\\", quote) and i + 1 < end and text[i + 1] == quote:
                    i += 1
                value.append(i)
                i += 1
            i = end + 1
        while i < len(text) and text[i] not in delimiters:
            if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in delimiters + QUOTES + "\\[]":
                i += 1
            value.append(i)
            i += 1
        while value and text[value[0]] in BLANKS + "\t":
            value.pop(0)
        while value and text[value[-1]] in BLANKS + "\t":
            value.pop()
        if value:
            out.append((place, [kept[x] for x in value]))
        if i >= len(text):
            return out
        place, i = place + 1, i + 1


def _rules(delimiters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("at", pa.list_(pa.int32()))]))
        for batch in batches:
            rules = [[{"pos": p, "at": at} for p, at in resolve(s, delimiters)] for s in batch["skeleton"].to_pylist()]
            yield pa.record_batch([batch["skeleton"], pa.array(rules, kind)], names=["skeleton", "rule"])

    return run


def split_packed(df: DataFrame, field: str, keys: list[str], delimiters: str = DELIMITERS) -> DataFrame:
    """``keys``, ``pos``, ``value``: one row for each value packed in ``field``."""
    specials = _specials(delimiters)
    rare = [c for c in dict.fromkeys(specials) if ord(c) > 255]  # a class that has these is slow, so only fields that have them are matched with it

    def matched(by: Callable[[str], Column]) -> Column:
        common = by(_class("".join(c for c in specials if c not in rare)))
        if not rare:
            return common
        return F.when(reduce(operator.or_, [F.col("packed").contains(c) for c in rare]), by(_class(specials))).otherwise(common)

    rows = df.where(F.col(field).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(field).alias("packed"))
    segments = matched(lambda special: F.regexp_extract_all("packed", F.lit(f"([^{special}]+|[{special}])"), F.lit(1)))
    skeleton = matched(lambda special: F.regexp_replace("packed", f"[^{special}]+", MASK))
    rows = rows.select("*", skeleton.alias("skeleton"))
    distinct = rows.select("skeleton").distinct()
    rules = materialize(distinct.mapInArrow(_rules(delimiters), "skeleton string, rule array<struct<pos: bigint, at: array<int>>>"), "rules")
    size = rules.select(F.sum(F.length("skeleton"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        joined = rows.join(F.broadcast(rules), "skeleton")
    else:  # one skeleton may be that of any part of all fields
        part = F.pmod(F.xxhash64("packed"), F.lit(PARTS)).cast("int").alias("part")
        joined = rows.select("*", part).join(rules.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), ["skeleton", "part"])
    joined = joined.withColumn("segments", segments)
    # texts are put together before they are exploded, so that no row carries all segments
    value = lambda v: F.struct(v["pos"].alias("pos"), F.array_join(F.transform(v["at"], lambda i: F.get("segments", i)), "").alias("text"))
    one = joined.select(*[f"k{i}" for i in range(len(keys))], F.explode(F.transform("rule", value)).alias("v"))
    return one.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("v.pos").alias("pos"), F.col("v.text").alias("value"))

"""Items that appear together: stripes with a log-likelihood ratio.

Items are numbered from the rarest on. Each item of a basket gives a stripe, the items
that are behind it by number, so a pair is kept with its rarer item and an item of most
baskets has hardly any stripe of its own. A task merges the stripes of its baskets before
they are shuffled by item and merged again; the stripe of an item of very many baskets is
shuffled in ``PARTS`` parts.

Two exact bounds keep the stripes short: a pair that is together ``min_count`` times has
two items with at least so many baskets, and as n(a,b) is at most the smaller of n(a) and
n(b), a pair whose ratio to chance is at least ``min_lift`` has no item that is in more
than 1/``min_lift`` of the baskets. The latter items are at most ``min_lift`` times as
many as a basket holds on average.

Edge cases: null ids and null, zero and NaN values are no occurrence; repeated rows count
once; an empty table gives an empty result; ids compare by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrix.core import renumbered
from sparrix.runtime import materialize

#: Items kept up to this number are broadcast to the baskets, more are shuffled.
BROADCAST_ITEMS = 200_000
#: A basket with more items is spread over several rows, by blocks of first items.
BLOCK = 1024
#: Parts of the stripe of an item of more than so many baskets that are merged apart from each other.
PARTS, MANY_BASKETS = 16, 50_000
#: The log-likelihood ratio that chance exceeds for one pair in a thousand.
SIGNIFICANT = 10.83
#: Pairs that one step of a task holds in memory.
PAIRS_AT_ONCE = 2_000_000


def _stripes(many: int, long: bool):
    """From rows (firsts, items), items ascending and firsts its head, to merged stripes; items from ``many`` on are of very many baskets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged_stripes(batches, many, np.int64 if long else np.int32)

    return run


def _part_of(a: np.ndarray, b: np.ndarray, many: int) -> np.ndarray:
    return np.where(a >= many, b % PARTS, 0).astype(np.int32)


def _merged_stripes(batches: Iterator[pa.RecordBatch], many: int, kind: type) -> Iterator[pa.RecordBatch]:
    a_held: list[np.ndarray] = []
    b_held: list[np.ndarray] = []
    n_held: list[np.ndarray] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = np.concatenate(a_held), np.concatenate(b_held), np.concatenate(n_held)
        order = np.lexsort((b, _part_of(a, b, many), a))
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return a[new], b[new], np.add.reduceat(n, new)

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = _part_of(a, b, many)
        start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]))))
        ends = np.append(start[1:], len(a))
        for lo in range(0, len(start), 10_000):
            s, e = start[lo : lo + 10_000], ends[lo : lo + 10_000]
            offsets = pa.array(np.append(s, e[-1]) - s[0], pa.int32())
            values = slice(s[0], e[-1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (b[values].astype(kind), n[values].astype(np.int32))]  # a task has fewer baskets
            yield pa.record_batch([pa.array(a[s].astype(kind)), pa.array(part[s]), *lists], names=["a", "part", "b", "n"])

    def pairs(first: np.ndarray, heads: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """first: bounds of the baskets' items; heads: how many of a basket are first items."""
        basket = np.repeat(np.arange(len(heads)), heads)
        at = first[basket] + np.arange(len(basket)) - np.repeat(np.cumsum(heads) - heads, heads)
        after = first[basket + 1] - at - 1
        total = np.cumsum(after)
        lo = 0
        while lo < len(at):
            hi = lo + max(1, int(np.searchsorted(total[lo:] - (total[lo - 1] if lo else 0), PAIRS_AT_ONCE, side="right")))
            k = after[lo:hi]
            a = np.repeat(at[lo:hi], k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            yield items[a], items[b]
            lo = hi

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch["items"]
        first = lists.offsets.to_numpy().astype(np.int64)
        for a, b in pairs(first - first[0], batch["heads"].to_numpy().astype(np.int64), lists.flatten().to_numpy()):
            a_held.append(a)
            b_held.append(b)
            n_held.append(np.ones(len(a), np.int64))
            held += len(a)
            if held > PAIRS_AT_ONCE:
                a, b, n = merged()
                if len(a) > PAIRS_AT_ONCE // 2:  # what cannot be merged here is merged after the shuffle
                    yield from rows(a, b, n)
                    a_held, b_held, n_held, held = [], [], [], 0
                else:
                    a_held, b_held, n_held, held = [a], [b], [n], len(a)
    if held:
        yield from rows(*merged())


def log_likelihood_ratio(nab: Column, na: Column, nb: Column, n: Column) -> Column:
    """G squared of the two-by-two table of baskets with and without either item."""

    def part(k: Column, row: Column, column: Column) -> Column:
        k = k.cast("double")
        return F.when(k > 0, k * F.log(k * n / (row.cast("double") * column))).otherwise(0.0)

    return 2 * (part(nab, na, nb) + part(na - nab, na, n - nb) + part(nb - nab, n - na, nb) + part(n - na - nb + nab, n - na, n - nb))


def cooccurrence(
    cells: DataFrame, basket: str = "samp_id", item: str = "obs_id", value: str | None = "value", min_count: int = 12, min_lift: float = 8.0, min_llr: float = SIGNIFICANT
) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift, llr)``, item_a < item_b.

    All pairs that are together in at least ``min_count`` baskets, at least ``min_lift``
    times as often as chance would have it, and whose log-likelihood ratio ``llr`` is at
    least ``min_llr``. ``n`` counts the baskets with any item. With k baskets, e expected,
    llr is at least 2 (k ln(k/e) - k + e), as x ln(x/y) >= x - y for the other three cells
    of the table; so a count of 12 and a lift of 8 give 28.9, and the significance bound
    leaves out none of them.
    """
    rows = cells.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    if value:
        v = F.col(value).cast("double")
        rows = rows.where(v.isNotNull() & (v != 0) & ~F.isnan(v))
    rows = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    rows = materialize(rows.repartition("basket").distinct(), "occurrences")
    n = rows.select(F.count_distinct("basket")).first()[0]
    counts = rows.groupBy("item").agg(F.count("*").alias("c")).where((F.col("c") >= min_count) & (F.col("c") * F.lit(float(min_lift)) <= n))
    items = materialize(renumbered(counts, "c", "item").withColumnRenamed("ord", "code"), "items")
    size, many = items.select(F.count("*"), F.coalesce(F.min(F.when(F.col("c") > MANY_BASKETS, F.col("code"))), F.lit((1 << 62)))).first()
    long = size >= 1 << 31
    known = items.select("item", "code")
    coded = rows.join(F.broadcast(known) if size <= BROADCAST_ITEMS else known, "item").select("basket", "code")
    baskets = coded.groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("items")).where(F.size("items") > 1)
    starts = F.explode(F.sequence(F.lit(0), F.size("items") - 1, F.lit(BLOCK)))
    blocks = baskets.select("items", starts.alias("start")).select(
        F.least(F.size("items") - F.col("start"), F.lit(BLOCK)).alias("heads"), F.expr("slice(items, start + 1, size(items))").alias("items")
    )
    kind = "long" if long else "int"
    stripes = blocks.mapInArrow(_stripes(many, long), f"a {kind}, part int, b array<{kind}>, n array<int>").repartition("a", "part")
    pairs = stripes.select("a", "part", F.explode(F.arrays_zip("b", "n")).alias("x")).select("a", "part", "x.b", "x.n")
    pairs = pairs.groupBy("a", "part", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    named = lambda x: items.select(F.col("code").alias(x), F.col("item").alias(f"i{x}"), F.col("c").alias(f"c{x}"))
    if size <= BROADCAST_ITEMS:
        pairs = pairs.join(F.broadcast(named("a")), "a").join(F.broadcast(named("b")), "b")
    else:  # pairs lie by item and part already, so the items go to them
        parts = F.explode(F.when(F.col("a") >= many, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part")
        first = named("a").select(F.col("a").cast(kind).alias("a"), parts, "ia", "ca")
        pairs = pairs.join(first, ["a", "part"]).drop("part").join(named("b").withColumn("b", F.col("b").cast(kind)), "b")
    swap = F.col("ia") > F.col("ib")
    out = pairs.select(
        F.least("ia", "ib").alias("item_a"), F.greatest("ia", "ib").alias("item_b"), "n_ab",
        F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("n_a"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("n_b"), F.lit(n).cast("long").alias("n"),
    )
    chance = F.col("n_a").cast("double") * F.col("n_b")
    # whole numbers are compared, so that a pair right at the bound is not lost to rounding
    exact = F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.col("n_a").cast("decimal(19,0)") * F.col("n_b") * F.lit(min_lift).cast("decimal(9,3)")
    out = out.where(exact).select(
        "*", (F.col("n_ab") * F.col("n") / chance).alias("lift"), log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")).alias("llr")
    )
    return out.where(F.col("llr") >= min_llr) if min_llr > 0 else out

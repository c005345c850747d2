"""Filling containers of fixed capacity with texts, with as little unused space as possible.

All planning is done on the histogram of lengths, whose size is bounded by the capacity,
not by the data; the plans of all kinds of container are made by tasks at the same time. A
configuration linear program (cover the histogram by the fewest containers, a variable for
each way to fill one) is solved by multiplicative weights: the lengths not yet covered have
the highest weights, and knapsack dynamic programming prices the best fill under the
weights. The solution is rounded down; real lengths are put for its classes and topped up
with what fits, and a fill is used while it leaves no more space than the plan made largest
first leaves on average. What remains is filled largest first. Of the two plans the one
with fewer containers is kept, the program's if they are equal. The plan says for each
length which ranks go to which containers; texts are ranked within their length by bucket,
without any group being gathered, and looked up in the plan.

Edge cases: a text without tokens is in no container; one that exceeds the capacity is
split into pieces of the capacity and a rest, others never; texts of equal length go by
their id; repeated rows of an id count once; without texts there are no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.runtime import materialize

#: Size classes of the linear program, and units of capacity in its pricing.
CLASSES = 96
UNITS = 512
#: The cover is to be within about this share of the best. It takes at most
#: CLASSES * ln(CLASSES + 1) / PRECISION ** 2 steps, about 69,000.
PRECISION, MOST_STEPS = 0.08, 80_000
#: Pricing is done in so many first steps and every so many later ones.
ALWAYS_PRICED, PRICED_EVERY = 150, 150
#: Items below this share of the capacity are left to fill what space remains.
SMALL = 1 / 48
#: Rows of one bucket of the ranking, about.
BUCKET_ROWS = 50_000
#: Kinds of container there may be: every text is packed once for each.
MOST_KINDS = 1000

Pattern = dict[int, int]


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often each item is taken in the most valuable fill, items being unlimited."""
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], usable[c]
        if k:
            gain = v[:k] + best[c - s[:k]]
            i = int(np.argmax(gain))
            if gain[i] > best[c]:
                best[c], choice[c] = gain[i], i
    taken, c = np.zeros(len(s), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= s[choice[c]]
    out = np.zeros(len(s), np.int64)
    out[order] = taken
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """A fractional cover of the demand by fills of one container: fills with their number.

    Each step uses the fill that is worth most under the weights a little more often.
    Pricing for a better one than those known is done for the first steps, then now and
    then, as the weights move slowly.
    """
    unit = max(1, -(-capacity // UNITS))
    units, room = -(-sizes // unit), capacity // unit
    most = np.maximum(1, demand).astype(np.int64)
    eta = np.log(len(sizes) + 1) / PRECISION
    cover, fills, uses = np.zeros(len(sizes)), np.zeros((0, len(sizes)), np.int64), []
    k = -1
    while True:
        k += 1
        level = cover / demand
        least = level.min()
        if least >= 1:
            break
        if k > MOST_STEPS:
            raise RuntimeError("the program did not converge within its bound")
        weight = np.exp(-eta * (level - least)) / demand
        worth = fills @ weight
        if k < ALWAYS_PRICED or not k % PRICED_EVERY:
            fill = np.minimum(knapsack(weight, units, room), most)
            if not len(fills) or fill @ weight > worth.max() * (1 + PRECISION / 10):
                fills, worth = np.vstack((fills, fill)), np.append(worth, fill @ weight)
                uses.append(0.0)
        best = int(np.argmax(worth))
        used = fills[best] > 0
        step = float((demand[used] / fills[best][used]).min()) * PRECISION / eta
        uses[best] += step
        cover = cover + step * fills[best]
    return [(f, x) for f, x in zip(fills, uses, strict=True) if x]


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fills, each with the number of containers so filled; every item is in one of them.

    Rounding the program may cost more than it gains, so the plan that fills largest first
    is made as well: it says how much space a fill may leave, and is kept if it needs fewer.
    """
    items = {s: n for s, n in sorted(histogram.items()) if n > 0}
    if any(s > capacity or s < 1 for s in items):
        raise ValueError("an item is larger than the capacity or empty")
    plain = _largest_first(dict(items), capacity)
    used = sum(times for _, times in plain)
    spare = capacity - sum(s * n for s, n in items.items()) / used if used else 0
    return min([*_by_program(items, capacity, int(spare)), plain], key=lambda plan: sum(times for _, times in plan))


def _largest_first(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    plan: list[tuple[Pattern, int]] = []
    while left:
        room, fill = capacity, {}
        for s in sorted(left, reverse=True):
            if s <= room:
                fill[s] = min(left[s], room // s)
                room -= s * fill[s]
        times = min(left[s] // k for s, k in fill.items())
        plan.append((fill, times))
        for s, k in fill.items():
            _take(left, s, k * times)
    return plan


#: Parts of the program's solution that are tried, as its last fills may leave worse rests than they are worth.
PARTS = (1.0, 0.5, 0.25, 0.1)


def _by_program(items: dict[int, int], capacity: int, spare: int) -> list[list[tuple[Pattern, int]]]:
    """Plans that use all or parts of the program's fills, and fill largest first what remains."""
    whole = [({capacity: 1}, items[capacity])] if capacity in items else []
    items = {s: n for s, n in items.items() if s < capacity}
    large = [s for s in items if s > capacity * SMALL]
    if not large:
        return []
    members, fills = _solved(items, large, capacity)
    plans = []
    for part in PARTS:
        left = dict(items)
        plan = _rounded(left, members, fills, part, capacity, spare)
        plans.append([*whole, *_filled(plan, left, capacity), *_largest_first(left, capacity)])
    return plans


def _take(left: dict[int, int], size: int, n: int) -> None:
    left[size] -= n
    if not left[size]:
        del left[size]


def _solved(items: dict[int, int], large: list[int], capacity: int) -> tuple[list[list[int]], list[tuple[np.ndarray, float]]]:
    """The lengths of each class, largest first, and the program's fills, the fullest first."""
    counts = np.array([items[s] for s in large])
    group = np.minimum((np.cumsum(counts) - 1) * CLASSES // counts.sum(), CLASSES - 1)
    members = [[s for s, g in zip(large, group, strict=True) if g == k][::-1] for k in range(CLASSES)]
    members = [m for m in members if m]
    sizes = np.array([m[0] for m in members])
    demand = np.array([sum(items[s] for s in m) for m in members], float)
    # the solution covers some classes more than once
    return members, sorted(configurations(sizes, demand, capacity), key=lambda x: (-(x[0] @ sizes), -x[1]))


def _rounded(left: dict[int, int], members: list[list[int]], fills: list[tuple[np.ndarray, float]], part: float, capacity: int, spare: int) -> list[tuple[Pattern, int]]:
    """A part of the solution rounded down, with real lengths for its classes."""
    plan: list[tuple[Pattern, int]] = []
    every = sorted(left, reverse=True)
    for fill, times in fills:
        times *= part
        times, used = int(times), np.flatnonzero(fill)
        while times > 0:
            # as long as the same real lengths last, the containers are alike
            real: Pattern = {}
            for k in used:
                need = int(fill[k])
                for s in members[k]:
                    take = min(need, left.get(s, 0) - real.get(s, 0))
                    if take > 0:
                        real[s] = real.get(s, 0) + take
                        need -= take
                    if not need:
                        break
            room = capacity - sum(s * n for s, n in real.items())
            for s in every:
                if s <= room and (more := min(room // s, left.get(s, 0) - real.get(s, 0))) > 0:
                    real[s] = real.get(s, 0) + more
                    room -= s * more
            if not real or room > spare:
                break
            alike = min(times, *(left[s] // n for s, n in real.items()))
            plan.append((real, alike))
            for s, n in real.items():
                _take(left, s, n * alike)
            times -= alike
    return plan


def _filled(plan: list[tuple[Pattern, int]], left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Puts what is left into the space that is left, the largest that fits first."""
    out, todo = [], plan[::-1]
    while todo:
        fill, times = todo.pop()
        room = capacity - sum(s * n for s, n in fill.items())
        fits = [s for s in left if s <= room]
        if not fits:
            out.append((fill, times))
            continue
        s = max(fits)
        each = min(room // s, max(1, left[s] // times))
        some = min(times, left[s] // each)
        _take(left, s, each * some)
        if times > some:
            todo.append((fill, times - some))
        todo.append((fill | {s: fill.get(s, 0) + each}, some))
    return out


def _lookup(plan: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """For each length, from which rank on which containers follow, and how many of the length each takes."""
    rows, rank, base = [], {}, 0
    for fill, times in plan:
        for s, n in fill.items():
            rows.append((s, rank.get(s, 0), base, n))
            rank[s] = rank.get(s, 0) + n * times
        base += times
    rows.sort()
    size, start, first, each = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return size, start, first, each


def ranked_within(df: DataFrame, by: list[str], order: str, rows: int) -> DataFrame:
    """Adds ``rank``, 0-based among the rows of equal ``by``, none of them null.

    Rows are ranked within buckets of the hash of ``order``, to which the number of rows in
    the buckets before is added, so one value may hold any part of all rows.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = df.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    local = df.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(order)) - 1)
    return local.join(counts, [*by, "bucket"]).withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "bucket")


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From capacities with their histograms to the look-ups of their plans."""
    for batch in batches:
        for kind, capacity, sizes, counts in zip(*(batch[c].to_pylist() for c in ("kind", "capacity", "sizes", "counts")), strict=True):
            plan = plan_containers(dict(zip(sizes, counts, strict=True)), capacity)
            yield pa.record_batch([pa.array([kind], pa.int32()), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in _lookup(plan)]], names=["kind", "size", "start", "first", "each"])


def pack_all(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_kind, container, doc, piece, tokens)`` for each kind of container.

    ``containers``: container_kind, capacity_tokens; a table of a few rows. Kinds without a
    positive capacity are left out. Containers are numbered from 0 in each kind; ``piece``
    is 0 but for the parts of a split text.
    """
    spark = sizes.sparkSession
    sizes = materialize(sizes.groupBy("doc").agg(F.max("tokens").alias("tokens")), "sizes")
    kinds = containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind", "capacity_tokens").limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    if not kinds:
        return sizes.select(F.lit("").alias("container_kind"), F.lit(0).cast("long").alias("container"), "doc", F.lit(0).cast("long").alias("piece"), "tokens").where("false")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(k["container_kind"]).alias("container_kind"), F.lit(int(k["capacity_tokens"])).cast("long").alias("c")) for i, k in enumerate(kinds)]))
    whole = sizes.select("doc", "tokens", each.alias("k")).select("k.*", "doc", "tokens")
    whole = whole.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("c")))).alias("piece"))
    pieces = whole.select("kind", "container_kind", "doc", "piece", F.least("c", F.col("tokens") - F.col("piece") * F.col("c")).cast("long").alias("tokens"))
    # at most as many rows as the capacities add up to
    counts = pieces.groupBy("kind", "tokens").agg(F.count("*").alias("n")).collect()
    histograms = [sorted((r["tokens"], r["n"]) for r in counts if r["kind"] == i) for i in range(len(kinds))]
    rows = [(i, int(k["capacity_tokens"]), [s for s, _ in h], [n for _, n in h]) for i, (k, h) in enumerate(zip(kinds, histograms, strict=True))]
    plans = spark.createDataFrame(rows, "kind int, capacity long, sizes array<long>, counts array<long>").repartition(len(kinds), "kind")
    plans = plans.mapInArrow(_planned, "kind int, size array<long>, start array<long>, first array<long>, each array<long>").collect()
    span = max(int(k["capacity_tokens"]) for k in kinds) + 1
    plans = sorted(plans, key=lambda r: r["kind"])
    size = np.concatenate([np.array(r["size"], np.int64) + r["kind"] * span for r in plans])
    start, first, takes = (np.concatenate([np.array(r[c], np.int64) for r in plans]) for c in ("start", "first", "each"))

    @F.arrow_udf(T.LongType())
    def container(kind: pa.Array, tokens: pa.Array, rank: pa.Array) -> pa.Array:
        k, s, r = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (kind, tokens, rank))
        s = s + k * span
        out = np.zeros(len(s), np.int64)
        for one in np.unique(s):
            lo, hi = np.searchsorted(size, one), np.searchsorted(size, one, side="right")
            mine = s == one
            at = lo + np.searchsorted(start[lo:hi], r[mine], side="right") - 1
            out[mine] = first[at] + (r[mine] - start[at]) // takes[at]
        return pa.array(out)

    most = max(sum(n for _, n in h) for h in histograms)
    ranked = ranked_within(pieces.withColumn("id", F.struct("doc", "piece")), ["kind", "tokens"], "id", most)
    return ranked.select("container_kind", container("kind", "tokens", "rank").alias("container"), "doc", "piece", "tokens")

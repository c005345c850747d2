"""Groups of records with alike composition: parallel pivot correlation clustering.

A record (sample) is a vector of shares that add up to one. Two records are alike if
the sum over features of the smaller of their two shares is at least ``threshold``.

Candidate pairs come from an exact prefix filter. Features get one global order, rare
ones first. If two records are alike, the first feature they have in common has, in
either record, at least ``threshold`` of mass at or behind it; so only features of that
prefix are join keys, which leaves out the frequent ones. All features held by more than
``HOT_KEY`` records are ranked by frequency, all others by hash: any order is exact, it
only has to put hot keys last.

Records of equal content are one vertex. A feature held by many records is a key only
together with a second common feature; records in which it alone reaches the threshold
are alike anyway. Groups need no more than their links to one of them; clusters take them
as a clique that is never written out, with all links from outside. A key of two features
that many records may have is split into blocks of records, compared two by two.

Edge cases: null ids and null, zero and NaN values are absent; records that hold a
negative or infinite value, or nothing, have no composition and are in no result; ties
between pivots go by hash, then by id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.runtime import discard, materialize

#: A share is kept in so many bits of a packed entry, the feature's hash in the others.
SHARE_BITS = 20
#: Vectors with more entries than this are compared by a join instead of in packed form.
PACKED_ENTRIES = 512
#: Features held by more records than this are keys only with a second feature. It bounds
#: the work for a key, so it does not grow with the data.
HOT_KEY = 2000
#: Records of a key of two features that are compared at once; more are split into blocks.
BLOCK_RECORDS = 20_000
#: Records of a group that are paired with all others by one task, about.
PART_RECORDS = 2000
#: Clusters of more records have their shares sorted in so many steps instead of at once.
WINDOW_RECORDS, STEPS = 200_000, 4096
#: Slots for candidate pairs that one step of the comparison holds in memory.
PAIRS_AT_ONCE = 2_000_000
#: Float sums of shares that should be equal differ by less than this.
EPSILON = 1e-9
#: Unsure pairs up to this number are broadcast to the vectors, more are shuffled.
BROADCAST_ROWS = 50_000

PACKED, STAR, LONG, EDGE = 0, 1, 2, 3


def feature_numbers(rows: DataFrame) -> tuple[int, bool, DataFrame]:
    """A seed under which no two features have the same hash, whether their codes differ too, and the frequent ones.

    The frequent ones, ``(feature, df)`` by their hash, are held by more than ``HOT_KEY``
    records (a record's cell sent twice counts twice), so all others are short keys
    whatever their order.
    """
    features = materialize(rows.groupBy("feature").agg(F.count("*").alias("df")), "features")
    seed = 42
    while True:
        h = F.xxhash64("feature", F.lit(seed))
        n, hashes, codes = features.agg(F.count("*"), F.count_distinct(h), F.count_distinct(F.shiftleft(h, SHARE_BITS))).first()
        if n == hashes:
            return seed, n == codes, features.where(F.col("df") > HOT_KEY).select(h.alias("feature"), "df")
        seed += 1


def composition_vectors(cells: DataFrame, record: str, feature: str, value: str, cell: str | None = None) -> tuple[DataFrame, bool]:
    """One row for each record: its features in the global order, with their shares; and whether codes tell features apart.

    Rows with the same ``cell`` count once, with the largest value; several cells of one
    record and feature are added. The vector of a record is bounded by the length of the
    feature axis. Features are named by a hash that is checked to differ for all of them.
    """
    v = F.col(value).cast("double")
    rows = cells.where(v.isNotNull() & (v != 0) & ~F.isnan(v) & F.col(record).isNotNull() & F.col(feature).isNotNull())
    rows = rows.select(F.col(record).cast("string").alias("record"), F.col(feature).alias("feature"), v.alias("value"), *([F.col(cell).alias("cell")] if cell else []))
    seed, differ, frequent = feature_numbers(rows)
    whole = not cell or isinstance(rows.schema["cell"].dataType, T.IntegralType)
    rows = rows.withColumn("feature", F.xxhash64("feature", F.lit(seed))).repartition("record")
    if not whole:
        rows = rows.groupBy("record", "feature", "cell").agg(F.max("value").alias("value")).drop("cell")
    number = F.coalesce(F.col("cell").cast("long"), F.lit(-1)) if cell and whole else F.monotonically_increasing_id()
    rows = rows.select("record", "feature", "value", number.alias("cell"))
    few = frequent.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(frequent) if few else frequent, "feature", "left").select("record", "feature", "value", "cell", F.coalesce("df", F.lit(0)).alias("df"))
    rows = (rows if few else rows.repartition("record")).sortWithinPartitions("record")
    packed = rows.mapInArrow(_vectors, "record string, df array<long>, feature array<long>, share array<double>")
    return packed.withColumns({"s1": F.xxhash64("feature", "share"), "s2": F.xxhash64("share", "feature", F.lit(1))}), differ


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cells (record, feature, value, cell, df), sorted by record, to one row for each record."""

    def runs(*columns: np.ndarray) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for table in _whole_groups(batches, "record"):
        names = table["record"].combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        rec = names.indices.to_numpy().astype(np.int64)
        feature, value, cell, df = (table[c].to_numpy() for c in ("feature", "value", "cell", "df"))
        order = np.lexsort((-value, cell, feature, rec))
        rec, feature, value, cell, df = (x[order] for x in (rec, feature, value, cell, df))
        once = runs(rec, feature, cell)
        rec, feature, value, df = rec[once], feature[once], value[once], df[once]
        first = runs(rec, feature)
        value, rec, feature, df = np.add.reduceat(value, first), rec[first], feature[first], df[first]
        order = np.lexsort((feature, feature << SHARE_BITS, df, rec))
        rec, feature, value, df = (x[order] for x in (rec, feature, value, df))
        first = runs(rec)
        n = np.diff(np.append(first, len(rec)))
        total = np.add.reduceat(value, first)
        good = (np.minimum.reduceat(value, first) > 0) & np.isfinite(total)
        kept = np.repeat(good, n)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n[good]))).astype(np.int32))
        share = (value / np.repeat(total, n))[kept]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (df[kept], feature[kept], share)]
        yield pa.record_batch([names.dictionary.take(pa.array(rec[first][good])).cast(pa.string()), *lists], names=["record", "df", "feature", "share"])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 30_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that cut no group; the rows come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        other = pa.compute.not_equal(table[key], table[key][-1])  # the last group may go on in the next batch
        cut = pa.compute.sum(other).as_py() or 0
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(lengths) places, its group and its place within the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - (np.cumsum(lengths) - lengths)[group]


def _positive(h: np.ndarray) -> np.ndarray:
    return (h >> 1) & np.int64(0x3FFF_FFFF_FFFF_FFFF) | 1


def _key_rows(threshold: float):
    """From vectors to one row for each key of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, shares = batch["record"], batch["share"]
            first = shares.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            share = shares.flatten().to_numpy(zero_copy_only=False)
            df = batch["df"].flatten().to_numpy(zero_copy_only=False)
            h = batch["feature"].flatten().to_numpy(zero_copy_only=False) << SHARE_BITS
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            last = first[row + 1]
            run_sum = np.concatenate(([0.0], np.cumsum(share)))
            behind = run_sum[last] - run_sum[:-1]  # mass at or behind each entry
            up = np.minimum(np.ceil(share * (1 << SHARE_BITS)), (1 << SHARE_BITS) - 1).astype(np.int64)
            codes = h | up
            slack = 1e-7  # running sums over a batch are less exact than EPSILON
            prefix = behind >= threshold - slack
            at = np.flatnonzero(prefix & (df <= HOT_KEY))
            hot = np.flatnonzero(prefix & (df > HOT_KEY))
            # records in which one hot feature reaches the threshold: all alike
            full = hot[share[hot] >= threshold - EPSILON]
            dom = np.zeros(len(n), np.int64)
            dom[row[full]] = _positive(h[full])
            yield from out(names, h[at], row[at], at, np.zeros(len(at), np.int32), codes, last, n, dom)
            room, lo = np.cumsum(last[hot] - hot), 0
            while lo < len(hot):  # a hot feature with each one behind it
                hi = lo + max(1, int(np.searchsorted(room[lo:] - (room[lo - 1] if lo else 0), PAIRS_AT_ONCE, side="right")))
                group, place = _spread(last[hot[lo:hi]] - hot[lo:hi] - 1)
                i = hot[lo:hi][group]
                j = i + 1 + place
                ok = (share[i] >= threshold - slack) | (behind[j] >= threshold - share[i] - slack)
                i, j = i[ok], j[ok]
                key = h[i] * 31 + (h[j] >> SHARE_BITS)
                # no more records than hold the first feature have the key: beyond a block's size, blocks are compared two by two
                blocks = -(-df[i] // BLOCK_RECORDS)
                yield from out(names, *blocked(names, key, row[i], i, blocks), codes, last, n, dom)
                lo = hi
            if len(full):
                order = full[np.argsort(h[full], kind="stable")]
                new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
                lead = order[np.flatnonzero(new)]
                of = lead[np.cumsum(new) - 1]
                rest = ~new
                # these pairs meet no others, so each has a key of its own
                yield record(names, h[order[rest]] ^ np.arange(rest.sum()), row[order[rest]], EDGE, names.take(pa.array(row[of[rest]])), np.minimum(share[order], share[of])[rest])
                yield record(names, ~h[lead], row[lead], STAR, None, share[lead])

    def blocked(names, key, rows, start, blocks):
        """Key, row, start and side of each entry, once for each pair of blocks it is in."""
        side = np.zeros(len(key), np.int32)
        if not len(key) or blocks.max() <= 1:
            return key, rows, start, side
        own, at = np.unique(rows, return_inverse=True)
        mine = np.array([crc32(x.encode()) for x in names.take(pa.array(own)).to_pylist()], np.int64)[at] % blocks
        entry, other = _spread(blocks)
        mine, several = mine[entry], blocks[entry] > 1
        low, high = np.minimum(mine, other), np.maximum(mine, other)
        key = np.where(several, key[entry] * 1_000_003 + low * 8191 + high, key[entry])
        return key, rows[entry], start[entry], np.where(low == high, 0, np.where(mine == low, 1, 2)).astype(np.int32)

    def out(names, key, rows, start, side, codes, last, n, dom) -> Iterator[pa.RecordBatch]:
        """Key rows with the packed entries from ``start`` to the vector's end, in bounded pieces."""
        packed = n[rows] <= PACKED_ENTRIES
        size = np.where(packed, last[start] - start, 0)
        lo = 0
        while lo < len(key):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + 1_000_000]), 1_000_000, side="right")))
            group, place = _spread(size[lo:hi])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(size[lo:hi]))).astype(np.int32)), pa.array(codes[start[lo:hi][group] + place])
            )
            kind = np.where(packed[lo:hi], PACKED, LONG).astype(np.int32)
            m = hi - lo
            yield pa.record_batch(
                [pa.array(key[lo:hi]), pa.array(side[lo:hi]), pa.array(dom[rows[lo:hi]]), names.take(pa.array(rows[lo:hi])), pa.array(kind), pa.nulls(m, pa.string()), pa.array(np.zeros(m)), lists], names=KEY_NAMES
            )
            lo = hi

    def record(names, key, rows, kind, other, similarity) -> pa.RecordBatch:
        m = len(rows)
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array([], pa.int64()))
        other = pa.nulls(m, pa.string()) if other is None else other.cast(pa.string())
        return pa.record_batch(
            [pa.array(key), pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int64)), names.take(pa.array(rows)), pa.array(np.full(m, kind, np.int32)), other, pa.array(np.asarray(similarity, float)), empty], names=KEY_NAMES
        )

    return run


KEY_NAMES = ["key", "side", "dom", "record", "kind", "other", "similarity", "codes"]
KEY_SCHEMA = "key long, side int, dom long, record string, kind int, other string, similarity double, codes array<long>"
PAIR_NAMES = ["a", "b", "similarity", "sure"]
PAIR_SCHEMA = "a string, b string, similarity double, sure boolean"


def _compare_buckets(threshold: float, chains: bool, codes_differ: bool):
    """Compares the records of each key; a partition comes sorted by key."""
    unit = float(1 << SHARE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "key"):
            yield from whole(table)

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0]
        kind = batch["kind"].to_numpy()
        names, sim = batch["record"], batch["similarity"].to_numpy()
        edge = np.flatnonzero((kind == EDGE) & chains)
        if len(edge):
            yield pairs(names.take(pa.array(edge)), batch["other"].take(pa.array(edge)), sim[edge], np.ones(len(edge), bool))
        star = np.flatnonzero((kind == STAR) & chains)
        if len(star):
            keys = batch["key"].to_numpy()[star]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            lead = star[np.flatnonzero(new)][np.cumsum(new) - 1]
            rest = np.flatnonzero(~new)
            if len(rest):
                yield pairs(names.take(pa.array(star[rest])), names.take(pa.array(lead[rest])), np.minimum(sim[star], sim[lead])[rest], np.ones(len(rest), bool))
        kept = np.flatnonzero((kind == PACKED) | (kind == LONG))
        if not len(kept):
            return
        if len(kept) < len(kind):
            batch = batch.take(pa.array(kept))
        keys = batch["key"].to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).astype(np.int64)
        m = np.diff(bounds)
        several = np.repeat(m > 1, m)  # a key of one record has no pair
        batch = batch.filter(pa.array(several))
        m = m[m > 1]
        if not len(m):
            return
        first = batch["codes"].offsets.to_numpy().astype(np.int64)
        codes = batch["codes"].values.to_numpy()
        long = batch["kind"].to_numpy() == LONG
        dom = batch["dom"].to_numpy()
        # a record's partners are the rows of its key behind it, but for those that share its dominant feature
        key = np.repeat(np.arange(len(m)), m)
        ends = np.cumsum(m)[key]
        def end_of(same: np.ndarray) -> np.ndarray:
            new = np.concatenate(([True], (same[1:] != same[:-1]) | (key[1:] != key[:-1])))
            return np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]

        side = batch["side"].to_numpy()
        partners = np.where(dom > 0, end_of(dom), np.arange(len(key)) + 1)
        # of two blocks, the records of the first have those of the second for partners
        partners = np.where(side == 0, partners, np.where(side == 1, end_of(side), ends))
        slots = ends - partners
        per_key = np.concatenate(([0], np.cumsum(slots)))[np.concatenate(([0], np.cumsum(m)))]
        row0, lo = 0, 0
        while lo < len(m):
            hi = lo + max(1, int(np.searchsorted(per_key[lo + 1 :] - per_key[lo], PAIRS_AT_ONCE, side="right")))
            n = int(m[lo:hi].sum())
            part = slice(row0, row0 + n)
            yield from compare(key[part] - lo, partners[part] - row0, slots[part], dom[part], row0, batch["record"], first, codes, long)
            row0 += n
            lo = hi

    def compare(key, partners, room, dom, row0, names, first, codes, long) -> Iterator[pa.RecordBatch]:
        n = len(key)
        e0, e1 = first[row0], first[row0 + n]
        row = np.repeat(np.arange(n), np.diff(first[row0 : row0 + n + 1]))
        h = codes[e0:e1] >> SHARE_BITS
        order = np.lexsort((h, key[row]))  # stable: rows ascend within a feature
        row, h = row[order], h[order]
        q = (codes[e0:e1][order] & ((1 << SHARE_BITS) - 1)).astype(np.float64)
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[row[1:]] != key[row[:-1]]))) if len(row) else np.zeros(0, bool)
        end = np.append(np.flatnonzero(new)[1:], len(row))[np.cumsum(new) - 1] if len(row) else np.zeros(0, np.int64)
        # where in its run the partners of an entry begin: rows ascend within a run
        run_of = np.cumsum(new) - 1
        begin = np.searchsorted(run_of * (n + 1) + row, run_of * (n + 1) + partners[row], side="left")
        after = np.maximum(0, end - begin)
        cost = np.concatenate(([0], np.cumsum(room)))  # slots before row i: all partners of the rows before
        i0 = 0
        while i0 < n:  # first rows i0 to i1 at once, so that a key of any size fits in memory
            i1 = min(n, max(i0 + 1, int(np.searchsorted(cost, cost[i0] + PAIRS_AT_ONCE, side="right")) - 1))
            slots = int(cost[i1] - cost[i0])
            if not slots:
                i0 = i1
                continue
            mine = np.flatnonzero((row >= i0) & (row < i1) & (after > 0))
            _, place = _spread(after[mine])
            a = np.repeat(mine, after[mine])
            b = begin[a] + place
            slot = cost[row[a]] - cost[i0] + row[b] - partners[row[a]]
            total = np.bincount(slot, np.minimum(q[a], q[b]), minlength=slots)
            hit = np.flatnonzero(total >= (threshold - EPSILON) * unit)
            i = np.searchsorted(cost, hit + cost[i0], side="right") - 1
            j = hit + cost[i0] - cost[i] + partners[i]
            linked = (dom[i] == dom[j]) & (dom[i] > 0)  # in two blocks
            hit, i, j = hit[~linked], i[~linked], j[~linked]
            common = np.bincount(slot, minlength=slots)[hit]  # each packed share is too large by less than one unit
            sure = (total[hit] - common >= (threshold + EPSILON) * unit) & codes_differ
            # for chains, of those with one dominant feature, which are linked anyway, the closest sure one is enough
            many = (dom[j] > 0) & sure & chains
            order = np.flatnonzero(many)[np.lexsort((-total[hit][many], dom[j][many], i[many]))]
            best = np.concatenate(([True], (i[order][1:] != i[order][:-1]) | (dom[j][order][1:] != dom[j][order][:-1]))) if len(order) else np.zeros(0, bool)
            keep = np.concatenate((np.flatnonzero(~many), order[best]))
            i, j = i[keep], j[keep]
            yield pairs(names.take(pa.array(row0 + i)), names.take(pa.array(row0 + j)), total[hit][keep] / unit, sure[keep])
            if long[row0 : row0 + n].any():  # not packed: compared exactly later on
                group, place = _spread(room[i0:i1])
                i = i0 + group
                j = partners[i] + place
                pick = long[row0 + i] | long[row0 + j]
                i, j = i[pick], j[pick]
                yield pairs(names.take(pa.array(row0 + i)), names.take(pa.array(row0 + j)), np.full(len(i), np.nan), np.zeros(len(i), bool))
            i0 = i1

    def pairs(a, b, similarity, sure) -> pa.RecordBatch:
        return pa.record_batch([a.cast(pa.string()), b.cast(pa.string()), pa.array(similarity), pa.array(sure)], names=PAIR_NAMES)

    return run


def _similarities(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of the given pairs, from the whole vectors."""
    count = pairs.count()
    if count <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    side = vectors.select("record", "feature", "share")
    joined = pairs.join(side.toDF("a", "fa", "sa"), "a")
    joined = (F.broadcast(joined) if count <= BROADCAST_ROWS else joined).join(side.toDF("b", "fb", "sb"), "b")
    shares = joined.select("a", "b", F.explode(F.arrays_zip("fa", "sa")).alias("x"), F.map_from_arrays("fb", "sb").alias("other"))
    shares = shares.select("a", "b", F.least("x.sa", F.try_element_at("other", F.col("x.fa"))).alias("s"), F.try_element_at("other", F.col("x.fa")).alias("o"))
    return shares.groupBy("a", "b").agg(F.sum(F.when(F.col("o").isNotNull(), F.col("s"))).alias("similarity"))


def alike_pairs(vectors: DataFrame, threshold: float, chains: bool = True, codes_differ: bool = True) -> DataFrame:
    """``(a, b, similarity)`` with a < b: alike vectors, each pair once.

    Records in which one hot feature alone reaches the threshold are all alike. With
    ``chains`` they are linked to one of them, and any other record to the closest of
    them; without, all pairs are given but those within ``dominant_cliques``. If two
    features have one code, packed sums may be too large, and all pairs are compared exactly.
    """
    keyed = vectors.select("record", "df", "feature", "share").mapInArrow(_key_rows(threshold), KEY_SCHEMA)
    found = keyed.repartition("key").sortWithinPartitions("key", "side", "dom").mapInArrow(_compare_buckets(threshold, chains, codes_differ), PAIR_SCHEMA)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", "sure")
    found = found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("sure").alias("sure"))
    found = materialize(found, "alike")
    unsure = found.where(~F.col("sure")).select("a", "b")
    sure = found.where("sure").select("a", "b", "similarity")
    if unsure.isEmpty():
        return sure
    return sure.unionByName(_similarities(vectors, unsure).where(F.col("similarity") >= threshold - EPSILON))


def dominant_cliques(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(id, clique)``: records in which one hot feature alone reaches the threshold, by that feature."""
    full = F.filter(F.arrays_zip("df", "feature", "share"), lambda x: (x["df"] > HOT_KEY) & (x["share"] >= threshold - EPSILON))
    return vectors.select(F.col("record").alias("id"), F.try_element_at(full, F.lit(-1))["feature"].alias("clique")).where("clique is not null")


def _rank(c: str) -> Column:
    """Hash order of the pivots; ties go by the id itself."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def pivot_clusters(pairs: DataFrame, cliques: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """``(id, pivot, similarity)`` for all ids of ``pairs`` (a, b, similarity; each once).

    In rounds, every live vertex whose hash is the least among its live neighbours is a
    pivot and absorbs them; then each member goes to the closest pivot it is linked to.
    The ids of each clique of ``cliques`` (id, clique) are neighbours too, without pairs;
    their similarities, and any that decide between pivots, are taken from ``vectors``.
    """
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = live = materialize(both, "links")
    inside = several = None if cliques is None else materialize(cliques, "cliques")
    pivots: DataFrame | None = None
    absorbed: DataFrame | None = None
    while True:
        least = live.select("a", _rank("b").alias("r"))
        if several is not None:
            heads = several.groupBy("clique").agg(F.min(_rank("id")).alias("r"), F.count("*").alias("n")).where("n > 1")
            several = materialize(several.join(heads.select("clique", "r"), "clique"), "cliques")
            # the head itself has only ids of a higher rank beside it
            least = least.unionByName(several.select("id", F.when(F.col("r.id") != F.col("id"), F.col("r")).alias("r")).toDF("a", "r"))
        least = least.groupBy("a").agg(F.min("r").alias("least"))
        chosen = materialize(least.where(F.col("least").isNull() | (_rank("a") < F.col("least"))).select(F.col("a").alias("id")), "pivots")
        pivots = chosen if pivots is None else pivots.unionByName(chosen)
        gone = chosen.unionByName(live.join(chosen.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")))
        if several is not None:
            gone = gone.unionByName(several.join(several.join(chosen, "id", "left_semi").select("clique"), "clique", "left_semi").select("id"))
        gone = gone.distinct()
        if several is not None:
            gone = materialize(gone, "gone")
            absorbed = gone if absorbed is None else absorbed.unionByName(gone)
            several = materialize(several.join(gone, "id", "left_anti").select("id", "clique"), "cliques")
        before, live = live, materialize(live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "live")
        if before is not both:
            discard(before)
        if live.isEmpty() and (several is None or several.groupBy("clique").count().where("count > 1").isEmpty()):
            break
    vertices = both.select(F.col("a").alias("id"))
    if inside is not None:
        # one whose neighbours all went to others in the same round is a pivot too
        vertices = vertices.unionByName(inside.join(inside.groupBy("clique").count().where("count > 1"), "clique", "left_semi").select("id"))
        pivots = materialize(pivots.unionByName(vertices.distinct().join(absorbed, "id", "left_anti")), "pivots")
    to_pivot = both.join(pivots.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "similarity")
    if inside is not None:
        heads = inside.join(pivots, "id", "left_semi").select("clique", F.col("id").alias("b"))
        to_pivot = to_pivot.unionByName(inside.join(heads, "clique").where("id <> b").select(F.col("id").alias("a"), "b", F.lit(None).cast("double").alias("similarity")))
        to_pivot = materialize(to_pivot.withColumn("choices", F.count("*").over(Window.partitionBy("a"))), "to_pivot")
        decided = _similarities(vectors, to_pivot.where("choices > 1 or similarity is null").select("a", "b")).select("a", "b", F.round("similarity", 9).alias("similarity"))
        to_pivot = to_pivot.where("choices = 1 and similarity is not null").select("a", "b", "similarity").unionByName(decided)
    best = F.max(F.struct("similarity", (-F.xxhash64("b")).alias("h"), F.col("b").alias("pivot"))).alias("best")
    joined = to_pivot.groupBy(F.col("a").alias("id")).agg(best).select("id", "best.pivot", "best.similarity")
    joined = joined.join(pivots, "id", "left_anti")
    mine = pivots.select("id", F.col("id").alias("pivot"), F.lit(1.0).alias("similarity"))
    # for groups, one that is left alone needs no more than its own label
    labels = mine.unionByName(joined)
    alone = vertices.distinct().join(labels, "id", "left_anti")
    return materialize(labels.unionByName(alone.select("id", F.col("id").alias("pivot"), F.lit(1.0).alias("similarity"))), "clusters")


def linked_groups(pairs: DataFrame) -> DataFrame:
    """``(id, grp)``: groups linked by chains of pairs.

    The pivot clusters are contracted to vertices and clustered again until no two of
    them are linked, which takes a number of rounds in the logarithm of the chains' length.
    """
    labels: DataFrame | None = None
    while True:
        now = pivot_clusters(pairs).select("id", F.col("pivot").alias("grp"))
        labels = now if labels is None else labels.join(now.select(F.col("id").alias("grp"), F.col("grp").alias("up")), "grp", "left").select(
            "id", F.coalesce("up", "grp").alias("grp")
        )
        up = now.select(F.col("id").alias("a"), F.col("grp").alias("ga"))
        over = pairs.join(up, "a").join(up.toDF("b", "gb"), "b").where("ga <> gb")
        over = over.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"), "similarity")
        before, pairs = pairs, materialize(over.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "over")
        discard(before)
        if pairs.isEmpty():
            return materialize(labels, "groups")


def _least_sums(shares: DataFrame) -> DataFrame:
    """``(rep, s)``: for each share of a feature in a cluster, the sum over the cluster's records of the smaller of theirs and it.

    ``shares``: rep, grp, feature, share, and the number w of records that have it so.
    """
    of = Window.partitionBy("grp", "feature")
    upto = of.orderBy("share").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.sum(F.col("w") * F.col("share")).over(upto) + F.col("share") * (F.sum("w").over(of) - F.sum("w").over(upto))
    return shares.select("rep", least.alias("s"))


def _least_sums_in_steps(shares: DataFrame) -> DataFrame:
    """``_least_sums`` for clusters of any size: equal shares are added up first, and sorted within steps of the share only."""
    step = F.floor(F.col("share") * STEPS).cast("int").alias("step")
    each = shares.groupBy("grp", "feature", "share").agg(F.sum("w").alias("w")).select("*", step)
    steps = each.groupBy("grp", "feature", "step").agg(F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("share")).alias("ss"))
    of = Window.partitionBy("grp", "feature").orderBy("step")  # at most STEPS + 1 rows
    below = F.coalesce(F.sum("ss").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.coalesce(F.sum("ws").over(of.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    steps = steps.select("grp", "feature", "step", "ws", below.alias("below"), above.alias("above"))
    inner = Window.partitionBy("grp", "feature", "step").orderBy("share").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("*", F.sum(F.col("w") * F.col("share")).over(inner).alias("upto"), F.sum("w").over(inner).alias("upto_w")).join(steps, ["grp", "feature", "step"])
    least = F.col("below") + F.col("upto") + F.col("share") * (F.col("ws") - F.col("upto_w") + F.col("above"))
    return shares.join(each.select("grp", "feature", "share", least.alias("s")), ["grp", "feature", "share"]).select("rep", "s")


class CompositionClusters:
    """Clusters of the records of ``cells`` with alike composition.

    Parameters: the column names of record, feature, value and cell, and the threshold.
    """

    def __init__(self, cells: DataFrame, record: str = "samp_id", feature: str = "obs_id", value: str = "value", cell: str | None = "cell_id", threshold: float = 0.55):
        self.threshold = threshold
        vectors, self.codes_differ = composition_vectors(cells, record, feature, value, cell)
        self.vectors = materialize(vectors, "vectors")
        same = self.vectors.groupBy("s1", "s2").agg(F.min("record").alias("rep"), F.count("*").alias("n")).where("n > 1")
        copies = self.vectors.select("record", "s1", "s2").join(same, ["s1", "s2"]).where("record <> rep")
        self.copies = materialize(copies.select("record", "rep"), "copies")
        few = self.copies.count()
        drop = self.copies.select("record")
        self.distinct = self.vectors.join(F.broadcast(drop) if few <= BROADCAST_ROWS else drop, "record", "left_anti") if few else self.vectors

    def groups(self) -> DataFrame:
        """``(record, grp)`` of the records that are linked to another by a chain of alike pairs."""
        pairs = materialize(alike_pairs(self.distinct, self.threshold, codes_differ=self.codes_differ), "pairs")
        return self._with_copies(linked_groups(pairs).withColumnRenamed("id", "record"), "grp")

    def _with_copies(self, labels: DataFrame, column: str) -> DataFrame:
        """Copies follow their representative, which is in a group by itself if it has no other."""
        copy = self.copies.join(labels.withColumnRenamed("record", "rep"), "rep", "left").select("record", "rep", F.coalesce(column, "rep").alias(column))
        lone = copy.join(labels.select(F.col("record").alias("rep")), "rep", "left_anti").select(F.col("rep").alias("record"), F.col("rep").alias(column))
        return labels.select("record", column).unionByName(copy.select("record", column)).unionByName(lone.distinct())

    def group_pairs(self) -> DataFrame:
        """``(a, b)`` with a < b: each pair of records in one group."""
        groups = materialize(self.groups(), "members")
        # a group's records are divided into parts, each joined with all of them, so no task makes more than a part of the pairs
        groups = groups.join(groups.groupBy("grp").agg(F.ceil(F.count("*") / PART_RECORDS).cast("int").alias("parts")), "grp")
        a = groups.select("grp", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int").alias("part"), F.col("record").alias("a"))
        b = groups.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("record").alias("b"))
        return a.join(b, ["grp", "part"]).where("a < b").select("a", "b")

    def _labels(self) -> DataFrame:
        pairs = materialize(alike_pairs(self.distinct, self.threshold, False, self.codes_differ), "pairs")
        return pivot_clusters(pairs, dominant_cliques(self.distinct, self.threshold), self.vectors).select(F.col("id").alias("record"), F.col("pivot").alias("grp"))

    def members(self) -> DataFrame:
        """``(record, pivot, similarity)``: each record with the pivot of its cluster and its similarity to it."""
        labels = self._with_copies(self._labels(), "grp")
        alone = self.vectors.select("record").join(labels, "record", "left_anti").select("record", F.col("record").alias("grp"))
        labels = materialize(labels.unionByName(alone), "labels")
        others = labels.where("record <> grp").select(F.col("record").alias("a"), F.col("grp").alias("b"))
        similarity = _similarities(self.vectors, others).select(F.col("a").alias("record"), F.round("similarity", 9).alias("similarity"))
        return labels.join(similarity, "record", "left").select("record", F.col("grp").alias("pivot"), F.when(F.col("record") == F.col("grp"), 1.0).otherwise(F.col("similarity")).alias("similarity"))

    def clusters(self, typical: int = 3) -> DataFrame:
        """``(cluster, size, medoid, typical)``; each record is in one cluster.

        The medoid has the largest sum of similarities to the others of its cluster, and
        names it; ``typical`` holds the first so many records by that sum, ties by id.
        """
        labels = self._labels()
        members = self._with_copies(labels, "grp").join(self.copies, "record", "left").select("record", "grp", F.coalesce("rep", "record").alias("rep"))
        members = materialize(members, "members")
        weight = members.groupBy("rep", "grp").agg(F.count("*").alias("w"))
        # for each feature, the others of a cluster count with their own share if it is smaller, else with the record's
        shares = self.vectors.select(F.col("record").alias("rep"), F.explode(F.arrays_zip("feature", "share")).alias("x"))
        shares = weight.join(shares, "rep").select("rep", "grp", F.col("x.feature").alias("feature"), F.col("x.share").alias("share"), "w")
        large = members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW_RECORDS).select("grp")
        if large.isEmpty():
            sums = _least_sums(shares)
        else:
            sums = _least_sums(shares.join(large, "grp", "left_anti")).unionByName(_least_sums_in_steps(shares.join(large, "grp", "left_semi")))
        sums = sums.groupBy("rep").agg(F.sum("s").alias("s"))
        scored = members.join(sums, "rep").select("record", "grp", F.round("s", 9).alias("s"))
        nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("s"), "record")).alias("nth")
        best = scored.select("record", "grp", nth).where(F.col("nth") <= typical).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("nth", "record"))).alias("x"))
        sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
        head = F.col("x")[0]["record"]
        out = best.join(sizes, "grp").select(head.alias("cluster"), "size", head.alias("medoid"), F.array_join("x.record", " ").alias("typical"))
        lone = self.vectors.join(members, "record", "left_anti")
        return out.unionByName(lone.select(F.col("record").alias("cluster"), F.lit(1).cast("long").alias("size"), F.col("record").alias("medoid"), F.col("record").alias("typical")))

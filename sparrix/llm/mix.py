"""Mixing sources to target shares of all tokens, each text used a capped number of times.

The texts of a source are laid end to end in hash order and cut into blocks of a fixed
number of tokens; the place of a text comes from sums over hash buckets, so a source may
hold any part of the data. A source's quota is its share of the total, at most its blocks
times its cap. The output is a row of shards of a fixed number of slots; each shard draws
its source counts from the multinomial distribution of the quotas, with a seed of its own
group of shards, so no task depends on another.

Correction: drawn counts differ from the quotas by chance, by about the square root of a
quota. When all shards have drawn, the drawn totals are known, one number for each source.
A source drawn too often gives up exactly the slots beyond its quota, picked by a
pseudorandom permutation of all its slots, so evenly over the shards; they go to the
sources drawn too seldom. The shares are then those planned, and a shard's counts differ
from a multinomial draw by a share of its slots that falls with the square root of the total.

Slot t of a source is block p(t mod n) of its n blocks, p a pseudorandom permutation of its
own for each pass, so no block is used twice in one pass. Slots and blocks are joined by
source and index.

The total is the largest at which all sources with any token reach their share, but not
less than ``LEAST_TOTAL`` of the listed sources' blocks; below that, sources short of
blocks give what the cap allows, and the others take up the difference by their shares.

Edge cases: sources that are not listed, null sources and texts without tokens are not
used; a listed source without tokens gives nothing and is reported with a share of 0;
null or negative shares and caps count as 0; repeated rows of an id count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrix.runtime import materialize

BLOCK_TOKENS = 256
#: Slots of a shard, and shards that are drawn together; both are fixed, so only their number grows.
SHARD_BLOCKS, GROUP = 64, 256
LEAST_TOTAL = 0.5
#: Sources that may be listed: their table is held by every task.
MOST_SOURCES = 10_000
BUCKET_ROWS = 50_000
ROUNDS = 4


def block_pieces(sizes: DataFrame, length: int, rows: int) -> DataFrame:
    """``(source, block, doc, from_token, to_token)`` from ``sizes`` (doc, source, tokens).

    The last block of a source may be shorter than ``length``.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    h = F.xxhash64(F.lit("order"), "doc")
    df = sizes.select("doc", "source", "tokens", h.alias("h"), F.pmod(h, F.lit(buckets)).alias("bucket"))
    sums = df.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    past = Window.unboundedPreceding
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(past, -1)), F.lit(0))
    local = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc").rowsBetween(past, -1)), F.lit(0))
    placed = df.select("*", local.alias("local")).join(sums.select("source", "bucket", before.alias("before")), ["source", "bucket"])
    placed = placed.select("source", "doc", "tokens", (F.col("local") + F.col("before")).alias("at"))
    n = F.lit(length)
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("at") / n), F.floor((F.col("at") + F.col("tokens") - 1) / n))).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * n) - F.col("at")
    end = F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * n) - F.col("at")
    return cut.select("source", "block", "doc", start.alias("from_token"), end.alias("to_token"))


def quotas(shares: dict[str, float], blocks: dict[str, int], caps: dict[str, int], least_total: float = LEAST_TOTAL) -> dict[str, int]:
    """Blocks each source gives to the mix."""
    most = {s: blocks.get(s, 0) * caps[s] for s in shares}
    live = {s: w for s, w in shares.items() if w > 0 and most[s] > 0}
    if not live:
        return dict.fromkeys(shares, 0)
    whole = sum(live.values())
    total = min(most[s] * whole / w for s, w in live.items())
    total = int(min(max(total, least_total * sum(blocks.get(s, 0) for s in live)), sum(most[s] for s in live)))
    given = dict.fromkeys(shares, 0.0)
    open_, rest = dict(live), float(total)
    while open_:
        full = [s for s, w in open_.items() if rest * w / sum(open_.values()) >= most[s]]
        if not full:
            given |= {s: rest * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in full:
            given[s] = float(most[s])
        rest -= sum(most[s] for s in full)
        for s in full:
            del open_[s]
    return {s: min(most[s], math.floor(x + 0.5)) for s, x in given.items()}


def drawn_counts(quota: np.ndarray, group: int, seed: int) -> np.ndarray:
    """Source counts of the shards of a group: a row for each shard, a column for each source."""
    total = int(quota.sum())
    first = group * GROUP * SHARD_BLOCKS
    sizes = np.minimum(SHARD_BLOCKS, np.maximum(0, total - first - np.arange(GROUP) * SHARD_BLOCKS))
    sizes = sizes[sizes > 0]
    rng = np.random.default_rng([seed, group])
    return rng.multinomial(sizes, quota / total)


def settled(source: np.ndarray, t: np.ndarray, quota: np.ndarray, drawn: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Source and number of each slot once drawn totals are brought to the quotas."""
    over, under = np.maximum(0, drawn - quota), np.maximum(0, quota - drawn)
    source, t = source.copy(), t.copy()
    mine = np.flatnonzero(over[source] > 0)
    s = source[mine]
    place = permuted(t[mine], drawn[s], s.astype(np.int64) * 7919 + seed)
    t[mine] = place
    away = place >= quota[s]
    given = mine[away]
    rank = (np.cumsum(over) - over)[s[away]] + place[away] - quota[s[away]]
    ends = np.cumsum(under)
    to = np.searchsorted(ends, rank, side="right")
    source[given] = to
    t[given] = drawn[to] + rank - (ends[to] - under[to])
    return source, t


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, at ``index``.

    A Feistel network over the next even number of bits, walked until it is in range.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << half) - 1

    def mixed(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    x, todo = index.astype(np.int64).copy(), np.arange(len(index))
    keys = key.view(np.uint64) if key.dtype == np.int64 else key.astype(np.uint64)
    while len(todo):
        lo, hi, m = x[todo] & mask[todo], x[todo] >> half[todo], mask[todo]
        for r in range(ROUNDS):
            lo, hi = hi ^ (mixed(lo, keys[todo] + np.uint64(r)) & m.astype(np.uint64)).astype(np.int64), lo
        x[todo] = hi << half[todo] | lo
        todo = todo[x[todo] >= n[todo]]
    return x


class SourceMix:
    """Parameters: ``sizes`` (doc, source, tokens), ``targets`` (source, target_share,
    max_repeats; a table of a few rows), block length, least total and seed."""

    def __init__(self, sizes: DataFrame, targets: DataFrame, length: int = BLOCK_TOKENS, least_total: float = LEAST_TOTAL, seed: int = 7):
        self.spark, self.length, self.seed = sizes.sparkSession, length, seed
        rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources are listed")
        self.shares = {r["source"]: max(0.0, float(r["w"] or 0)) for r in rows}
        self.caps = {r["source"]: max(0, int(r["r"] or 0)) for r in rows}
        listed = sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
        self.sizes = materialize(listed.groupBy("doc").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")), "sizes")
        totals = self.sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()  # a row for each listed source
        self.tokens = {r["source"]: int(r["tokens"]) for r in totals}
        self.rows = sum(r["n"] for r in totals)
        self.blocks = {s: -(-n // length) for s, n in self.tokens.items()}
        self.quota = quotas(self.shares, self.blocks, self.caps, least_total)

    def _groups(self) -> DataFrame:
        slots = sum(self.quota.values())
        return self.spark.range(0, -(-slots // (GROUP * SHARD_BLOCKS)))

    def _drawn(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        names = sorted(self.quota)
        return names, np.array([self.quota[s] for s in names], np.int64), np.array([self.blocks.get(s, 0) for s in names], np.int64)

    def slots(self) -> DataFrame:
        """``(shard, slot, source, repeat_no, block)``: which block stands where."""
        names, quota, blocks = self._drawn()
        seed = self.seed

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch["id"].to_pylist():
                    n = drawn_counts(quota, g, seed).sum(axis=0)
                    yield pa.record_batch([pa.array(np.full(len(n), g)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["group", "source", "n"])

        # a row for each group of shards and source
        counts = materialize(self._groups().mapInArrow(count, "group long, source int, n long"), "drawn")
        drawn = np.zeros(len(names), np.int64)
        for row in counts.groupBy("source").agg(F.sum("n").alias("n")).collect():  # as many as sources
            drawn[row["source"]] = row["n"]
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("group", "source", before.alias("before")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("source", "before"))).alias("x")).select("group", F.col("x.before").alias("before"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, first in zip(batch["group"].to_pylist(), batch["before"].to_pylist(), strict=True):
                    yield slots_of(g, np.array(first, np.int64))

        def slots_of(g: int, first: np.ndarray) -> pa.RecordBatch:
            counts = drawn_counts(quota, g, seed)
            sizes = counts.sum(axis=1)
            shard = np.repeat(np.arange(len(sizes)), sizes)
            source = np.repeat(np.tile(np.arange(len(names)), len(sizes)), counts.ravel())
            order = np.lexsort((np.random.default_rng([seed, g, 1]).random(len(source)), shard))  # the slots of a shard in random order
            source = source[order]
            slot = np.arange(len(source)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            by_source = np.argsort(source, kind="stable")
            n = np.bincount(source, minlength=len(names))
            t = np.empty(len(source), np.int64)
            t[by_source] = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
            source, t = settled(source, t + first[source], quota, drawn, seed)
            repeat = t // blocks[source]
            block = permuted(t % blocks[source], blocks[source], (source * 1_000_003 + repeat).astype(np.int64) * 15_485_863 + seed)
            columns = [pa.array(g * GROUP + shard), pa.array(slot), pa.array(names, pa.string()).take(pa.array(source)), pa.array(repeat), pa.array(block)]
            return pa.record_batch(columns, names=["shard", "slot", "source", "repeat_no", "block"])

        return starts.mapInArrow(place, "shard long, slot long, source string, repeat_no long, block long")

    def mixed(self) -> DataFrame:
        """``(shard, slot, source, repeat_no, block, doc, from_token, to_token)``: the pieces of texts in order."""
        pieces = block_pieces(self.sizes, self.length, self.rows)
        return self.slots().join(pieces, ["source", "block"]).select("shard", "slot", "source", "repeat_no", "block", "doc", "from_token", "to_token")

    def shares_reached(self) -> DataFrame:
        """``(source, target_share, share, tokens, available_tokens, max_repeats, most_used, reached)``."""
        used = self.slots().groupBy("source").agg(
            F.sum(F.when(F.col("block") == self._last(), self._rest()).otherwise(F.lit(self.length))).alias("tokens"), (F.max("repeat_no") + 1).alias("most_used")
        )
        rows = [(s, w, self.tokens.get(s, 0), self.caps[s]) for s, w in sorted(self.shares.items())]
        known = self.spark.createDataFrame(rows, "source string, target_share double, available_tokens long, max_repeats long")
        joined = known.join(F.broadcast(used), "source", "left").na.fill(0, ["tokens", "most_used"]).coalesce(1)
        share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1)))
        return joined.select(
            "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("share"), "tokens", "available_tokens", "max_repeats", "most_used",
            (F.abs(F.coalesce(share, F.lit(0.0)) - F.col("target_share")) <= 0.01).alias("reached"),
        )

    def _by_source(self, values: dict[str, int]):
        return F.create_map(*[F.lit(x) for s, n in values.items() for x in (s, n)])[F.col("source")] if values else F.lit(0)

    def _last(self):
        return self._by_source({s: n - 1 for s, n in self.blocks.items()})

    def _rest(self):
        return self._by_source({s: n - (self.blocks[s] - 1) * self.length for s, n in self.tokens.items()})

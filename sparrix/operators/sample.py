"""Random subsamples that do not depend on partitioning: the seed of a vector is its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from sparrix.core import MatrixTable


def draw(counts: np.ndarray, n: int, with_replacement: bool, rng: np.random.Generator) -> np.ndarray:
    """Counts of ``n`` draws from a vector of counts.

    Without replacement counts are cut to whole numbers, and a vector of fewer than ``n``
    gives nothing; with replacement they are rounded up.
    """
    if with_replacement:
        p = np.ceil(counts)
        return rng.multinomial(n, p / p.sum()).astype(float)
    whole = counts.astype(np.int64)
    if whole.sum() < n:
        return np.zeros(len(counts))
    return rng.multivariate_hypergeometric(whole, n, method="marginals").astype(float)


class SampleOps:
    def subsample(self, n: int, axis: str = "sample", by_id: bool = False, with_replacement: bool = False, seed: int = 0) -> MatrixTable:
        """``n`` counts of each sample, or ``n`` ids of an axis.

        Counts are always drawn for each sample, whatever the axis. Vectors that lose all
        counts are dropped: of both axes, or by id of the other one. The same seed gives
        the same result however the table is partitioned.
        """
        if n < 0:
            raise ValueError("a negative number of draws")
        if by_id and with_replacement:
            raise ValueError("ids are drawn without replacement")
        frame, _ = self._axis(axis)
        if by_id:
            chosen = frame.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("id")
            return self._semi(axis, chosen, False).remove_empty(self._other(axis))
        return self._present(_drawn(self.cells, n, with_replacement, seed))

    def _present(self, cells: DataFrame) -> MatrixTable:
        """The table of cells that are all above 0, with the ids that have one."""
        axes = {axis: frame.join(cells.select(F.col(key).alias("id")).distinct(), "id", "left_semi") for axis, (frame, key) in ((a, self._axis(a)) for a in ("observation", "sample"))}
        return self._new(cells, axes["observation"], axes["sample"])

    def subsample_by_hash(self, n: int, seed: int = 0) -> MatrixTable:
        """``subsample`` without replacement within the JVM, unit by unit.

        For small counts: it makes a row of each unit. A window ordered by a seeded hash
        picks the units, so the result does not depend on partitioning.
        """
        from pyspark.sql import Window

        units = self.cells.where("value >= 1").select("obs_id", "samp_id", F.explode(F.sequence(F.lit(1), F.floor("value"))).alias("u"))
        total = F.count("*").over(Window.partitionBy("samp_id")).alias("total")
        nth = F.row_number().over(Window.partitionBy("samp_id").orderBy(F.xxhash64(F.lit(seed), "samp_id", "obs_id", "u"), "obs_id", "u")).alias("nth")
        kept = units.select("obs_id", "samp_id", total, nth).where((F.col("nth") <= n) & (F.col("total") >= n))
        return self._present(kept.groupBy("obs_id", "samp_id").agg(F.count("*").cast("double").alias("value")))

    def subsamples(self, n: int, axis: str = "sample", by_id: bool = False, seed: int = 0) -> Iterator[MatrixTable]:
        """Endless subsamples, each with a seed of its own."""
        while True:
            yield self.subsample(n, axis, by_id, seed=seed)
            seed += 1


def _drawn(cells: DataFrame, n: int, with_replacement: bool, seed: int) -> DataFrame:
    """A vector is drawn by one task, whose memory bounds its length; its seed is its own."""
    o, k = cells.schema["obs_id"].dataType, cells.schema["samp_id"].dataType

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("obs_id")
        rng = np.random.default_rng([seed, crc32(str(table["samp_id"][0].as_py()).encode())])
        value = draw(table["value"].to_numpy(), n, with_replacement, rng)
        return table.set_column(2, "value", pa.array(value)).filter(pa.array(value > 0))

    schema = T.StructType([T.StructField("obs_id", o), T.StructField("samp_id", k), T.StructField("value", T.DoubleType())])
    return cells.select("obs_id", "samp_id", "value").groupBy("samp_id").applyInArrow(run, schema)

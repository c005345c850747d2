"""Operators on the non-zero values of each vector; zeros stay zeros."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from sparrix.core import MatrixTable

METHODS = ("average", "min", "max", "dense", "ordinal")


class WindowOps:
    def _cells_new(self, value: Column, zeros: bool = True) -> MatrixTable:
        cells = self.cells.select("obs_id", "samp_id", value.alias("value"))
        return self._new(cells.where(F.col("value").isNotNull() & (F.col("value") != 0)) if zeros else cells)

    def norm(self, axis: str = "sample", gather: bool = False) -> MatrixTable:
        """Each value divided by the sum of its vector. A vector whose values add up to 0 has no shares: it is left without cells.

        Totals are aggregated and joined, so no vector is held in one task. With
        ``gather`` each vector is brought together instead, which saves an exchange where
        all vectors are short.
        """
        _, key = self._axis(axis)
        if gather:
            return self._cells_new(F.try_divide("value", F.sum("value").over(Window.partitionBy(key))))
        totals = self.cells.groupBy(key).agg(F.sum("value").alias("total"))
        cells = self.cells.join(totals, key).select("obs_id", "samp_id", F.try_divide("value", "total").alias("value"))
        return self._new(cells.where(F.col("value").isNotNull() & (F.col("value") != 0)))

    def pa(self) -> MatrixTable:
        """Presence and absence: 1 for every non-zero, also a negative one."""
        return self._cells_new(F.lit(1.0), zeros=False)

    def rankdata(self, axis: str = "sample", method: str = "average") -> MatrixTable:
        """Ranks of the non-zeros in each vector, from 1; ties by one of ``METHODS``."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        _, key = self._axis(axis)
        w = Window.partitionBy(key).orderBy("value")
        ties = F.count("*").over(Window.partitionBy(key, "value"))
        if method == "ordinal":  # ties in the order of the other axis
            other, other_key = self._axis(self._other(axis))
            order = other.select(F.col("id").alias(other_key), F.col("ord").alias("o"))
            ranked = self.cells.join(order, other_key).select("obs_id", "samp_id", F.row_number().over(Window.partitionBy(key).orderBy("value", "o")).cast("double").alias("value"))
            return self._new(ranked)
        rank = {
            "average": lambda: F.rank().over(w) + (ties - 1) / 2,
            "min": lambda: F.rank().over(w),
            "max": lambda: F.rank().over(w) + ties - 1,
            "dense": lambda: F.dense_rank().over(w),
        }[method]()
        return self._cells_new(rank.cast("double"), zeros=False)

    def transform(self, f: Column | Callable[[np.ndarray, Any, dict | None], np.ndarray | float], axis: str = "sample") -> MatrixTable:
        """New values for the non-zeros; those that become 0 or null are dropped.

        f: a column over ``obs_id``, ``samp_id``, ``value`` and the axis' ``md``; or a
        function of a vector's non-zeros, its id and metadata.
        """
        frame, key = self._axis(axis)
        has_md = self.has_metadata(axis)
        if isinstance(f, Column):
            cells = self.cells.join(frame.select(F.col("id").alias(key), "md"), key) if has_md else self.cells
            cells = cells.select("obs_id", "samp_id", f.cast("double").alias("value"))
            return self._new(cells.where(F.col("value").isNotNull() & (F.col("value") != 0)))
        vectors = self.vectors(axis, dense=False).where("values is not null")
        other_key = "obs_id" if key == "samp_id" else "samp_id"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, row in enumerate(zip(pdf["id"], pdf["values"], strict=True)):
                    id_, items = row
                    values = np.array([x["value"] for x in items])
                    values = np.broadcast_to(f(values, id_, pdf["md"].iloc[i] if has_md else None), values.shape)
                    yield pd.DataFrame({key: [id_] * len(items), other_key: [x["id"] for x in items], "value": np.asarray(values, float)})

        schema = T.StructType([T.StructField(key, self.cells.schema[key].dataType), T.StructField(other_key, self.cells.schema[other_key].dataType), T.StructField("value", T.DoubleType())])
        cells = vectors.mapInPandas(run, schema).select("obs_id", "samp_id", "value")
        return self._new(cells.where((F.col("value") != 0) & ~F.isnan("value")))

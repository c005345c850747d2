"""Filters: by ids, by what a vector sums up to, by metadata or by a callable."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from types import FunctionType
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrix.errors import UnknownIDError

if TYPE_CHECKING:
    from sparrix.core import MatrixTable

#: A caller's list is broadcast up to this length.
LISTED = 100_000
VectorTest = Callable[[np.ndarray, Any, dict | None], bool]


class FilterOps:
    def filter(self, keep: Iterable[Any] | DataFrame | Column | VectorTest, axis: str = "sample", invert: bool = False) -> MatrixTable:
        """Keeps the ids of an axis that are listed or pass a test, or with ``invert`` the others.

        keep: ids; a frame with ``id``; a column over ``id``, ``md`` and the vector's
        ``total``, ``nnz``, ``least``, ``most`` (of the non-zeros, null if there are none);
        or a function of the dense values, the id and the metadata. A null test keeps
        nothing. The order stays as it is.
        """
        frame, key = self._axis(axis)
        if isinstance(keep, Column):
            test = F.coalesce(keep, F.lit(False))
            kept = self.vector_stats(axis).where(~test if invert else test).select("id")
        elif isinstance(keep, DataFrame):
            return self._semi(axis, keep.select("id"), invert)
        elif isinstance(keep, Iterable):
            ids = list(keep)
            listed = frame.sparkSession.createDataFrame([(x,) for x in ids], f"id {frame.schema['id'].dataType.simpleString()}")
            if missing := listed.join(frame, "id", "left_anti").first():
                raise UnknownIDError(missing[0], axis)
            return self._semi(axis, F.broadcast(listed) if len(ids) <= LISTED else listed, invert)
        elif isinstance(keep, FunctionType):
            kept = self._passing(keep, axis, invert)
        else:
            raise TypeError("filter by ids, a frame, a column or a function")
        return self._semi(axis, kept, False)

    def _semi(self, axis: str, ids: DataFrame, invert: bool) -> MatrixTable:
        frame, key = self._axis(axis)
        how = "left_anti" if invert else "left_semi"
        return self._with_axis(axis, frame.join(ids, "id", how), self.cells.join(ids.withColumnRenamed("id", key), key, how).select("obs_id", "samp_id", "value"))

    def _passing(self, test: VectorTest, axis: str, invert: bool) -> DataFrame:
        vectors = self.vectors(axis)
        has_md = self.has_metadata(axis)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                md = pdf["md"] if has_md else [None] * len(pdf)
                yield pdf.loc[[bool(test(np.asarray(v), i, m)) != invert for v, i, m in zip(pdf["values"], pdf["id"], md, strict=True)], ["id"]]

        return vectors.mapInPandas(run, vectors.select("id").schema)

    def vector_stats(self, axis: str = "sample") -> DataFrame:
        """The axis with ``total``, ``nnz``, ``least`` and ``most`` of each vector."""
        frame, key = self._axis(axis)
        stats = self.cells.groupBy(F.col(key).alias("id")).agg(
            F.sum("value").alias("total"), F.count("*").alias("nnz"), F.min("value").alias("least"), F.max("value").alias("most")
        )
        return frame.join(stats, "id", "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "nnz": F.coalesce("nnz", F.lit(0))})

    def remove_empty(self, axis: str = "whole") -> MatrixTable:
        """Drops vectors whose sum is not above 0; for ``whole``, samples first."""
        if axis == "whole":
            return self.remove_empty("sample").remove_empty("observation")
        _, key = self._axis(axis)
        kept = self.cells.groupBy(F.col(key).alias("id")).agg(F.sum("value").alias("total")).where("total > 0").select("id")
        return self._semi(axis, kept, False)

    def head(self, n: int = 5, m: int = 5) -> MatrixTable:
        """The first ``n`` observations and ``m`` samples."""
        if n <= 0 or m <= 0:
            raise IndexError("head takes positive numbers")
        obs, samp = (self._axis(a)[0].orderBy("ord").limit(k) for a, k in (("observation", n), ("sample", m)))
        hint = F.broadcast if max(n, m) <= LISTED else lambda df: df
        cells = self.cells.join(hint(obs.select(F.col("id").alias("obs_id"))), "obs_id", "left_semi")
        cells = cells.join(hint(samp.select(F.col("id").alias("samp_id"))), "samp_id", "left_semi")
        return self._new(cells.select("obs_id", "samp_id", "value"), obs, samp)

"""Aggregates over vectors. Zeros count where the operator says so, by way of the axis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.errors import TableError

if TYPE_CHECKING:
    pass


# The headings of the report's two parts, for totals or numbers of non-zeros, by axis.
HEADINGS = {
    (False, "sample"): ("Counts/sample", "Counts/sample"),
    (False, "observation"): ("Counts/sample", "Counts/sample"),
    (True, "sample"): ("Observations/sample", "Observations/sample"),
    (True, "observation"): ("Sample/observations", "Observations/sample"),
}


def _fold(pairs: Column, n: int, f: Callable[[Column, Column], Column]) -> Column:
    """The fold over a vector of ``n`` values of which ``pairs`` has the non-zeros in order."""
    zero = F.lit(0.0)

    def zeros(acc: Column, k: Column) -> Column:
        one = f(acc, zero)
        two = f(one, zero)
        every = F.aggregate(F.sequence(F.lit(1).cast("long"), k), acc, lambda a, _: f(a, zero))
        same = one.eqNullSafe(two) & one.cast("string").eqNullSafe(two.cast("string"))  # -0.0 is not 0.0
        return F.when(k <= 0, acc).when((k == 1) | same, one).otherwise(every)

    first = F.get(pairs, F.lit(0))
    start = F.struct(F.lit(1).cast("long").alias("at"), F.when(first["pos"] == 0, first["value"]).otherwise(zero).alias("value"))
    step = lambda acc, x: F.struct((x["pos"] + 1).alias("at"), f(zeros(acc["value"], x["pos"] - acc["at"]), x["value"]).alias("value"))
    return F.aggregate(F.filter(pairs, lambda x: x["pos"] > 0), start, step, lambda acc: zeros(acc["value"], F.lit(n).cast("long") - acc["at"]))


class AggregateOps:
    def sum(self, axis: str = "whole") -> DataFrame:
        """``(id, total)`` of an axis, 0 for a vector without cells; or ``(total)`` of all."""
        if axis == "whole":
            return self.cells.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
        return self._joined(axis, F.sum("value"), "total", F.lit(0.0))

    def _joined(self, axis: str, agg: Column, name: str, default: Column | None) -> DataFrame:
        frame, key = self._axis(axis)
        grouped = self.cells.groupBy(F.col(key).alias("id")).agg(agg.alias(name))
        joined = frame.select("id").join(grouped, "id", "left")
        return joined if default is None else joined.withColumn(name, F.coalesce(name, default))

    def min(self, axis: str = "sample") -> DataFrame:
        """``(id, least)``: the least non-zero of each vector, or of all (``whole``).

        Null for a vector without cells; ``strict_min`` makes that an error.
        """
        return self.cells.agg(F.min("value").alias("least")) if axis == "whole" else self._joined(axis, F.min("value"), "least", None)

    def max(self, axis: str = "sample") -> DataFrame:
        """``(id, most)``: the greatest non-zero of each vector, or of all."""
        return self.cells.agg(F.max("value").alias("most")) if axis == "whole" else self._joined(axis, F.max("value"), "most", None)

    def strict(self, result: DataFrame) -> DataFrame:
        """A result of ``min`` or ``max`` that fails where a vector has no cells."""
        name = result.columns[-1]
        return result.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit("a vector has no non-zero value"))).otherwise(F.col(name)))

    def nonzero_counts(self, axis: str = "sample", binary: bool = True) -> DataFrame:
        """``(id, n)``: non-zeros of each vector, or with ``binary=False`` their sum; any other axis is the whole."""
        agg = F.count("*").cast("double") if binary else F.sum("value")
        if axis not in ("sample", "observation"):
            return self.cells.agg(F.coalesce(agg, F.lit(0.0)).alias("n"))
        return self._joined(axis, agg, "n", F.lit(0.0))

    def reduce(self, f: Callable[[float, float], float] | Callable[[Column, Column], Column], axis: str = "sample", column: bool = False) -> DataFrame:
        """``(id, value)``: a left fold over each dense vector, zeros included.

        ``f`` must depend on its two values only: zeros in a row are folded until one of
        them changes nothing, so dense vectors are not made. With ``column``, ``f``
        combines two columns and the fold runs within the JVM.
        """
        if self.is_empty():
            raise TableError("cannot reduce an empty table")
        frame, key = self._axis(axis)
        other = self._other(axis)
        _, other_key = self._axis(other)
        n = self.length(other)
        positions = self.positions(other).withColumnRenamed("id", other_key)
        pairs = self.cells.join(positions, other_key).groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("pairs"))
        vectors = frame.select("id").join(pairs, "id", "left")
        if column:
            return vectors.select("id", _fold(F.coalesce("pairs", F.array().cast(pairs.schema["pairs"].dataType)), n, f).alias("value"))

        def zeros(acc: float, k: int) -> float:
            while k > 0:
                before, acc, k = acc, f(acc, np.float64(0)), k - 1
                if (acc == before and np.signbit(acc) == np.signbit(before)) or (acc != acc and before != before):  # noqa: PLR0124
                    break
            return acc

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, folded, lo = batch["pairs"], [], 0
                flat = lists.flatten()
                places, values = flat.field("pos").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
                for size in lists.value_lengths().fill_null(0).to_pylist():
                    hi = lo + size
                    first = size and places[lo] == 0
                    acc, at, lo = (values[lo] if first else np.float64(0)), 1, lo + bool(first)
                    for place, x in zip(places[lo:hi].tolist(), values[lo:hi], strict=True):
                        acc, at = f(zeros(acc, place - at), x), place + 1
                    folded.append(float(zeros(acc, n - at)))
                    lo = hi
                yield pa.record_batch([batch["id"], pa.array(folded, pa.float64())], names=["id", "value"])

        return vectors.mapInArrow(run, T.StructType([vectors.schema["id"], T.StructField("value", T.DoubleType())]))

    def summary(self, axis: str = "sample", binary: bool = False) -> DataFrame:
        """``(mn, mx, med, mean, sd, total)`` of the vectors' totals, or of their numbers of non-zeros.

        ``sd`` is the population's standard deviation.
        """
        per = self.nonzero_counts(axis, binary=binary)
        n = F.col("n")
        return per.agg(
            F.min(n).alias("mn"), F.max(n).alias("mx"), F.median(n).alias("med"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd"), F.sum(n).alias("total")
        )

    def summary_text(self, qualitative: bool = False, axis: str = "sample") -> str:
        """The report of the summarize command."""
        rows, columns = self.shape
        total = self.sum().first()[0]
        density = self.density()
        per = self.nonzero_counts(axis, binary=qualitative)
        s = self.summary(axis, binary=qualitative).first()
        summary, detail = HEADINGS[qualitative, axis]
        lines = [f"Num samples: {columns:,}", f"Num observations: {rows:,}"]
        if not qualitative:
            lines += [f"Total count: {total:,.0f}", f"Table density (fraction of non-zero values): {density:1.3f}"]
        lines += ["", f"{summary} summary:"]
        for name, value in (("Min", s["mn"]), ("Max", s["mx"]), ("Median", s["med"]), ("Mean", s["mean"]), ("Std. dev.", s["sd"])):
            lines.append(f" {name}: {value or 0:,.3f}")
        for name, one in (("Sample", "sample"), ("Observation", "observation")):
            keys = self._axis(one)[0].schema["md"].dataType.names if self.has_metadata(one) else []
            lines.append(f" {name} Metadata Categories: {'; '.join(keys) if keys else 'None provided'}")
        lines += ["", f"{detail} detail:"]
        frame, _ = self._axis(axis)
        detail = per.join(frame.select("id", "ord"), "id").orderBy("n", "ord")
        lines += [f"{r['id']}: {r['n']:,.3f}" for r in detail.toLocalIterator()]
        return "\n".join(lines)

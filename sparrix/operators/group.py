"""Partitioning an axis by label and collapsing the groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.core_types import label_type

if TYPE_CHECKING:
    from sparrix.core import MatrixTable

Label = Column | Callable[[Any, dict | None], Any] | Mapping[Any, Any]
VectorReducer = Callable[[np.ndarray], float]
#: Reducers that need no Python; besides, ``percentile:p``.
REDUCERS = ("sum", "mean", "min", "max", "median", "count")
#: A caller's list is broadcast up to this length.
LISTED = 100_000


def _parts_of(how: str) -> dict[str, Column]:
    """What is aggregated of the non-zero values for a reducer."""
    v = F.col("value")
    if _share_of(how) is not None:
        return {"values": F.sort_array(F.collect_list(v)), "below": F.count(F.when(v < 0, 1))}
    known = {"sum": {"s": F.sum(v)}, "mean": {"s": F.sum(v)}, "min": {"s": F.min(v)}, "max": {"s": F.max(v)}, "count": {"s": F.count(v)}}
    if how not in known:
        raise ValueError(f"unknown reducer {how!r}")
    return known[how]


def _share_of(how: str) -> float | None:
    return 0.5 if how == "median" else float(how.split(":")[1]) if how.startswith("percentile:") else None


def _reduction(how: str) -> Column:
    """The result from the parts, the members and the zeros among them."""
    s, zeros = F.col("s"), F.col("zeros")
    if how in ("sum", "count"):
        return s
    if how == "mean":
        return s / F.col("members")
    if how in ("min", "max"):
        return F.when(zeros > 0, (F.least if how == "min" else F.greatest)(s, F.lit(0.0))).otherwise(s)
    at = (F.col("members") - 1) * F.lit(_share_of(how))

    def ranked(i: Column) -> Column:
        """The value of a rank among all values: the zeros stand behind those below 0."""
        i = i.cast("int")
        below = F.col("below")
        return F.when(i < below, F.get("values", i)).when(i < below + zeros, F.lit(0.0)).otherwise(F.get("values", (i - zeros).cast("int")))

    low, high = ranked(F.floor(at)), ranked(F.ceil(at))
    return low + (high - low) * (at - F.floor(at))


def _of_each(f: Callable[[Any, dict | None], Any], arrow: pa.DataType, spark_type: T.DataType):
    """A column function of ids and metadata, called for each id within an Arrow batch."""

    @F.arrow_udf(spark_type)
    def run(ids: pa.Array, md: pa.Array) -> pa.Array:
        return pa.array([f(i, m) for i, m in zip(ids.to_pylist(), md.to_pylist(), strict=True)], arrow)

    return run


class GroupOps:
    def labels(self, by: Label, axis: str = "sample") -> DataFrame:
        """The axis with a ``label``.

        by: a column over ``id`` and ``md``; a mapping of ids to labels or of labels to
        lists of ids, told apart by its first value; or a function of id and metadata.
        """
        frame, _ = self._axis(axis)
        if isinstance(by, Column):
            return frame.withColumn("label", by)
        if isinstance(by, Mapping):
            first = next(iter(by.values()), None)
            if isinstance(first, list | tuple):
                pairs = [(i, str(label)) for label, ids in by.items() for i in ids]
            elif isinstance(first, str):
                pairs = list(by.items())
            else:
                raise ValueError("a mapping must have text or lists for values")
            kind = frame.schema["id"].dataType.simpleString()
            named = frame.sparkSession.createDataFrame(pairs, f"id {kind}, label string")
            return frame.join(F.broadcast(named) if len(pairs) <= LISTED else named, "id", "left")
        return frame.withColumn("label", _of_each(lambda i, m: label_type(by(i, m)), pa.string(), T.StringType())("id", self._md(axis)))

    def _md(self, axis: str) -> Column:
        return F.col("md") if self.has_metadata(axis) else F.lit(None).cast("string")

    def partition(self, by: Label, axis: str = "sample", remove_empty: bool = False, ignore_none: bool = False) -> Iterator[tuple[Any, MatrixTable]]:
        """Label and table of each group, in the order in which labels first occur.

        Ids without a label form the group None unless ``ignore_none``. Tables are not
        computed until they are used.
        """
        labelled = self.labels(by, axis).cache()
        try:
            order = labelled.groupBy("label").agg(F.min("ord").alias("o")).orderBy("o").collect()  # one row for each group that the caller gets
            for row in order:
                if row["label"] is None and ignore_none:
                    continue
                ids = labelled.where(F.col("label").eqNullSafe(F.lit(row["label"]))).select("id")
                table = self._semi(axis, ids, False)
                yield row["label"], table.remove_empty() if remove_empty else table
        finally:
            labelled.unpersist()

    def partition_sizes(self, by: Label, axis: str = "sample") -> DataFrame:
        """``(label, members, cells, total)`` of each group, the group without label included."""
        labelled = self.labels(by, axis).select("id", "label")
        _, key = self._axis(axis)
        per = self.cells.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("c"), F.sum("value").alias("v"))
        return labelled.join(per, "id", "left").groupBy("label").agg(
            F.count("*").alias("members"), F.coalesce(F.sum("c"), F.lit(0)).alias("cells"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")
        )

    def collapse(
        self, by: Label, axis: str = "sample", how: str | VectorReducer | Callable[[Column], Column] = "sum", norm: bool = True, min_group_size: int = 1, metadata: bool = True, nonzeros: bool = False,
    ) -> MatrixTable:
        """One vector for each label, in the order in which labels first occur.

        how: one of ``REDUCERS``, ``percentile:p`` (p from 0 to 1, interpolated), or a
        function of the group's dense values along the members, in their order, that
        gives a number. All of them see the zeros, which are counted and not made. With
        ``nonzeros``, ``how`` is an aggregate function of the value column (``F.stddev``
        ...) that sees the non-zero values alone. ``norm`` divides by the number of
        members, those without cells included. Groups of fewer than ``min_group_size``
        members and ids without a label are left out. Metadata is ``collapsed_ids``, the
        members in order.
        """
        labelled = self.labels(by, axis).where("label is not null").select("id", "ord", "label")
        _, key = self._axis(axis)
        other, other_key = self._axis(self._other(axis))
        groups = labelled.groupBy("label").agg(F.count("*").alias("members"), F.min("ord").alias("ord"))
        if min_group_size > 1:
            groups = groups.where(F.col("members") >= min_group_size)
            labelled = labelled.join(groups.select("label"), "label", "left_semi")
        to_label = labelled.select(F.col("id").alias(key), "ord", "label")
        if nonzeros:
            cells = self.cells.join(to_label, key).groupBy("label", other_key).agg(how(F.col("value")).alias("value"))
        elif callable(how):
            cells = self._reduced(how, to_label, groups, key, other, other_key)
        else:
            counted = self.cells.join(to_label, key).groupBy("label", other_key)
            parts = _parts_of(how)
            counted = counted.agg(*[agg.alias(name) for name, agg in parts.items()], F.count("*").alias("n"))
            if how != "sum":
                counted = counted.join(groups.select("label", "members"), "label").withColumn("zeros", F.col("members") - F.col("n"))
            cells = counted.select("label", other_key, _reduction(how).alias("value"))
        if norm:
            cells = cells.join(groups.select("label", "members"), "label").withColumn("value", F.col("value") / F.col("members"))
        cells = cells.where("value <> 0").select(F.col("label").alias(key), other_key, F.col("value").cast("double").alias("value")).select("obs_id", "samp_id", "value")
        new = groups.select(F.col("label").alias("id"), "ord")
        if metadata:
            ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
            members = labelled.groupBy(F.col("label").alias("id")).agg(F.struct(ids.alias("collapsed_ids")).alias("md"))
            new = new.join(members, "id")
        return self._with_axis(axis, new, cells)

    def _reduced(self, how: VectorReducer, to_label: DataFrame, groups: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
        """``(label, other id, value)`` by a function of dense vectors, for all pairs with a cell, and for the others where zeros do not give zero."""
        place = (F.row_number().over(Window.partitionBy("label").orderBy("ord")) - 1).alias("place")
        placed = self.cells.join(to_label.select(key, "label", place), key)
        vectors = placed.groupBy("label", other_key).agg(F.collect_list(F.struct("place", "value")).alias("values"))
        vectors = vectors.join(groups.select("label", "members"), "label").select("label", other_key, "members", "values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, members = batch["values"], batch["members"].to_pylist()
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                flat = lists.flatten()
                places, values = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("place", "value"))
                out = []
                for i, n in enumerate(members):
                    dense = np.zeros(n)
                    dense[places[at[i] : at[i + 1]]] = values[at[i] : at[i + 1]]
                    out.append(float(how(dense)))
                yield pa.record_batch([batch["label"], batch[other_key], pa.array(out, pa.float64())], names=["label", other_key, "value"])

        schema = T.StructType([vectors.schema["label"], vectors.schema[other_key], T.StructField("value", T.DoubleType())])
        cells = vectors.mapInArrow(run, schema)

        @F.arrow_udf(T.DoubleType())
        def of_zeros(members: pa.Array) -> pa.Array:
            return pa.array([float(how(np.zeros(n))) for n in members.to_pylist()], pa.float64())

        filled = groups.select("label", of_zeros("members").alias("value")).where("value <> 0")
        if filled.isEmpty():
            return cells
        # a reducer for which zeros do not give zero makes a dense result: these labels times the other axis, as asked for
        every = filled.join(other.select(F.col("id").alias(other_key)))
        return cells.unionByName(every.join(cells, ["label", other_key], "left_anti").select("label", other_key, "value"))

    def collapse_one_to_many(
        self, bins: Column | Callable[[Any, dict | None], Iterator[tuple[Any, Any]]], axis: str = "observation", mode: str = "add", key: str = "Path", metadata: bool = True, strict: bool = False,
    ) -> MatrixTable:
        """Adds each vector to every bin it names, to each in full or divided by their number.

        bins: an array column over ``id`` and ``md``, of bins or of structs (path, bin); or
        a generator function of id and metadata that yields (path, bin). Repeated bins of
        an id count repeatedly. A null bin is an incomplete path: it is skipped, or an
        error if ``strict``. Bins are sorted; metadata is the greatest path of a bin.
        """
        if mode not in ("add", "divide"):
            raise ValueError(f"unknown mode {mode!r}")
        from sparrix.core import renumbered

        frame, axis_key = self._axis(axis)
        _, other_key = self._axis(self._other(axis))
        if isinstance(bins, Column):
            named = frame.select("id", bins.alias("bins"))
        else:

            def run(i: Any, m: dict | None) -> list[dict[str, str | None]]:
                out, walk = [], iter(bins(i, m))
                while True:
                    try:
                        path, bin_ = next(walk)
                    except StopIteration:
                        return out
                    except IndexError:
                        if strict:
                            raise
                        continue
                    out.append({"path": label_type(path), "bin": label_type(bin_)})

            arrow = pa.list_(pa.struct([("path", pa.string()), ("bin", pa.string())]))
            spark_type = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("bin", T.StringType())]))
            named = frame.select("id", _of_each(run, arrow, spark_type)("id", self._md(axis)).alias("bins"))
        element = named.schema["bins"].dataType.elementType
        pair = element.typeName() == "struct"
        if not pair:
            named = named.withColumn("bins", F.transform("bins", lambda x: F.struct(x.cast("string").alias("path"), x.cast("string").alias("bin"))))
        if strict:
            bad = F.exists("bins", lambda x: x["bin"].isNull())
            named = named.withColumn("bins", F.when(bad, F.raise_error(F.lit("an incomplete path"))).otherwise(F.col("bins")))
        named = named.withColumn("bins", F.filter("bins", lambda x: x["bin"].isNotNull()))
        each = named.select(F.col("id").alias(axis_key), F.size("bins").alias("n"), F.explode("bins").alias("b")).select(axis_key, "n", "b.path", "b.bin")
        value = F.col("value") / F.col("n") if mode == "divide" else F.col("value")
        cells = self.cells.join(each, axis_key).groupBy("bin", other_key).agg(F.sum(value).alias("value")).where("value <> 0")
        new = renumbered(each.groupBy(F.col("bin").alias("id")).agg(F.struct(F.max("path").alias(key)).alias("md")), "id")
        new = new.select("id", "ord", "md") if metadata else new.select("id", "ord")
        return self._with_axis(axis, new, cells.select(F.col("bin").alias(axis_key), other_key, "value").select("obs_id", "samp_id", "value"))

    def collapse_levels(self, levels: Column, axis: str = "observation") -> DataFrame:
        """``(level, path, other id, value)``: sums at every depth of a lineage in one pass.

        An addition to the reference surface; ``levels`` is an array column over ``md``.
        """
        frame, key = self._axis(axis)
        _, other_key = self._axis(self._other(axis))
        paths = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(levels, F.lit(1), n), "; ").alias("path")))
        each = frame.where(F.size(levels) > 0).select(F.col("id").alias(key), F.explode(paths).alias("p"))
        return self.cells.join(each, key).groupBy("p.level", "p.path", other_key).agg(F.sum("value").alias("value"))

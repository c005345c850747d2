"""The table: cells in coordinate form, one frame for each axis, and a few properties.

``cells`` holds (obs_id, samp_id, value), one row for each non-zero cell. ``obs`` and
``samp`` hold (id, ord) and optionally ``md``, a struct of metadata; ids without cells are
on their axis all the same. ``ord`` gives the order of an axis; it may have gaps, as
operators that only drop ids leave it as it is.

All operators return a new table and run nothing, unless they have to report an error or
a number. An absent metadata key is null; an axis without ``md`` has no metadata.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.errors import TableError, UnknownAxisError, errcheck
from sparrix.operators.aggregate import AggregateOps
from sparrix.operators.axis import AxisOps
from sparrix.operators.combine import CombineOps
from sparrix.operators.filter import FilterOps
from sparrix.operators.group import GroupOps
from sparrix.operators.pairwise import PairwiseOps
from sparrix.operators.sample import SampleOps
from sparrix.operators.window import WindowOps
from sparrix.runtime import materialize

#: The kinds of table of the exchange format.
TABLE_TYPES = ("OTU table", "Pathway table", "Function table", "Ortholog table", "Gene table", "Metabolite table", "Taxon table")


@dataclass(frozen=True)
class Props:
    """Scalar properties; group metadata maps a category to (data type, value)."""

    table_id: str | None = None
    type: str | None = None
    create_date: datetime | None = None
    generated_by: str | None = None
    format_version: tuple[int, int] = (2, 1)
    obs_group_md: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    samp_group_md: Mapping[str, tuple[str, str]] = field(default_factory=dict)


#: An axis of more ids than this is numbered in parts; one task sorts fewer.
ONE_TASK = 2_000_000
#: A plan estimated at fewer bytes than this has not so many rows, and is not counted.
FEW_BYTES = 32 << 20


def renumbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``ord`` from 0 without gaps, by ``order``, whose values differ.

    Up to ``ONE_TASK`` rows are sorted in one task. More are sorted by range into a table
    of parts; the rows before a part are added to the places within it.
    """
    plain = df.withColumn("ord", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= FEW_BYTES:
        return plain
    rows = df.count()
    if rows <= ONE_TASK:
        return plain
    parts = -(-rows // ONE_TASK) * 2
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), nth.alias("__nth"))
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__part", before.alias("__before")))  # a row for each part
    return ranged.join(starts, "__part").withColumn("ord", (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")


class MatrixTable(AxisOps, FilterOps, AggregateOps, WindowOps, GroupOps, CombineOps, SampleOps, PairwiseOps):
    def __init__(self, cells: DataFrame, obs: DataFrame, samp: DataFrame, props: Props | None = None):
        self.cells, self.obs, self.samp, self.props = cells, obs, samp, props or Props()

    # -- building

    @classmethod
    def from_triples(
        cls, df: DataFrame, obs: str | Column = "obs_id", samp: str | Column = "samp_id", value: str | Column = "value",
        obs_axis: DataFrame | None = None, samp_axis: DataFrame | None = None, props: Props | None = None, unique: bool = False,
    ) -> MatrixTable:
        """Values of equal coordinates are added, zeros and nulls dropped.

        ``obs_axis`` and ``samp_axis`` hold id and optionally ord and md; without them an
        axis has the ids that occur, sorted. Rows with a null id are left out. With
        ``unique`` the coordinates are known to differ and nothing is shuffled.
        """
        o, s, v = (F.col(x) if isinstance(x, str) else x for x in (obs, samp, value))
        rows = df.select(o.alias("obs_id"), s.alias("samp_id"), v.cast("double").alias("value")).where("obs_id is not null and samp_id is not null")
        cells = rows if unique else rows.groupBy("obs_id", "samp_id").agg(F.sum("value").alias("value"))
        cells = cells.where(F.col("value") != 0)
        return cls(cells, cls._frame(rows, "obs_id", obs_axis), cls._frame(rows, "samp_id", samp_axis), props)

    @staticmethod
    def _frame(rows: DataFrame, key: str, axis: DataFrame | None) -> DataFrame:
        if axis is None:
            return renumbered(rows.select(F.col(key).alias("id")).distinct(), "id")
        kept = [c for c in ("id", "ord", "md") if c in axis.columns]
        axis = axis.select(*kept)
        return axis if "ord" in kept else renumbered(axis, "id")

    @classmethod
    def from_data(
        cls, spark: SparkSession, data: Any, observation_ids: Sequence[Any], sample_ids: Sequence[Any],
        observation_metadata: Sequence[Mapping[str, Any] | None] | None = None, sample_metadata: Sequence[Mapping[str, Any] | None] | None = None,
        props: Props | None = None, input_is_dense: bool = False, validate: bool = True,
    ) -> MatrixTable:
        """From driver-side data: a dense array, rows of arrays or dicts, ``{(r, c): v}``, or ``[r, c, v]`` triples.

        A list of lists holds triples unless ``input_is_dense``.
        """
        triples = _triples(data, input_is_dense, len(observation_ids), len(sample_ids))
        if isinstance(data, np.ndarray) and data.ndim == 2 and data.size and data.shape != (len(observation_ids), len(sample_ids)):
            raise TableError(f"{data.shape} values for {len(observation_ids)} observations and {len(sample_ids)} samples")
        for r, c, _ in triples:
            if not (0 <= r < len(observation_ids) and 0 <= c < len(sample_ids)):
                raise TableError(f"cell {r}, {c} is outside the axes")
        obs = axis_frame(spark, observation_ids, observation_metadata)
        samp = axis_frame(spark, sample_ids, sample_metadata)
        o, s = obs.schema["id"].dataType, samp.schema["id"].dataType
        schema = T.StructType([T.StructField("obs_id", o), T.StructField("samp_id", s), T.StructField("value", T.DoubleType())])
        rows = spark.createDataFrame([(_plain(observation_ids[r]), _plain(sample_ids[c]), float(v)) for r, c, v in triples], schema)
        table = cls.from_triples(rows, obs_axis=obs, samp_axis=samp, props=props)
        if validate:
            table.validate()
        return table

    def _new(self, cells: DataFrame | None = None, obs: DataFrame | None = None, samp: DataFrame | None = None, **props: Any) -> MatrixTable:
        return MatrixTable(
            self.cells if cells is None else cells, self.obs if obs is None else obs, self.samp if samp is None else samp, replace(self.props, **props) if props else self.props
        )

    # -- axes

    def _axis(self, axis: str) -> tuple[DataFrame, str]:
        """The frame of an axis and its key in the cells."""
        if axis == "sample":
            return self.samp, "samp_id"
        if axis == "observation":
            return self.obs, "obs_id"
        raise UnknownAxisError(axis)

    @staticmethod
    def _other(axis: str) -> str:
        if axis not in ("sample", "observation"):
            raise UnknownAxisError(axis)
        return "observation" if axis == "sample" else "sample"

    def _with_axis(self, axis: str, frame: DataFrame, cells: DataFrame | None = None, **props: Any) -> MatrixTable:
        return self._new(cells=cells, **{"samp" if axis == "sample" else "obs": frame}, **props)

    def validate(self, *names: str) -> MatrixTable:
        """Runs the checks of the error profile; the table itself if none raises."""
        errcheck(self, *names)
        return self

    def cache(self) -> MatrixTable:
        for frame in (self.cells, self.obs, self.samp):
            frame.cache()
        return self


def _plain(x: Any) -> Any:
    return x.item() if isinstance(x, np.generic) else x


def axis_frame(spark: SparkSession, ids: Sequence[Any], metadata: Sequence[Mapping[str, Any] | None] | None = None) -> DataFrame:
    """An axis from driver-side ids and metadata; metadata that is empty throughout is none."""
    ids = [_plain(i) for i in ids]
    if metadata is not None and len(metadata) != len(ids):
        raise TableError(f"{len(metadata)} metadata entries for {len(ids)} ids")
    kind = T.LongType() if ids and all(isinstance(i, int) for i in ids) else T.StringType()
    schema = T.StructType([T.StructField("id", kind), T.StructField("ord", T.LongType())])
    ids = ids if isinstance(kind, T.LongType) else [None if i is None else str(i) for i in ids]
    if metadata is None or not any(metadata):
        return spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), schema)
    if not all(m is None or isinstance(m, Mapping) for m in metadata):
        raise TableError("metadata must be mappings")
    keys = list(dict.fromkeys(k for m in metadata for k in m or {}))
    md = T.StructType([T.StructField(k, _type_of([m[k] for m in metadata if m and m.get(k) is not None])) for k in keys])
    schema = schema.add("md", md)
    rows = [(i, n, tuple(_coerced((m or {}).get(f.name), f.dataType) for f in md) if m is not None else None) for n, (i, m) in enumerate(zip(ids, metadata, strict=True))]
    return spark.createDataFrame(rows, schema)


def _type_of(values: list[Any]) -> T.DataType:
    """The narrowest type that holds all values."""
    if values and all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return T.LongType()
    if values and all(isinstance(v, int | float) and not isinstance(v, bool) for v in values):
        return T.DoubleType()
    if values and all(isinstance(v, list | tuple) for v in values):
        return T.ArrayType(_type_of([x for v in values for x in v if x is not None]))
    return T.StringType()


def _coerced(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_coerced(v, kind.elementType) for v in value]
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else repr(value)
    return float(value) if isinstance(kind, T.DoubleType) else value


def _are_columns(stacked: list[tuple[int, int, int, float]], vectors: int, rows: int, columns: int) -> bool:
    """Whether a list of dicts holds columns. Its length says so if the axes differ in length.

    On a square table they are columns if keys name several rows and one column only.
    """
    if rows != columns:
        return vectors == columns
    return any(r for _, r, _, _ in stacked) and not any(c for _, _, c, _ in stacked)


def _triples(data: Any, dense: bool, rows: int, columns: int) -> list[tuple[int, int, float]]:
    if hasattr(data, "tocoo"):  # a sparse matrix
        coo = data.tocoo()
        return [(int(r), int(c), float(v)) for r, c, v in zip(coo.row, coo.col, coo.data, strict=True)]
    if isinstance(data, np.ndarray):
        data = data.reshape(1, -1) if data.ndim == 1 and data.size else data
        return [(int(r), int(c), float(data[r, c])) for r, c in zip(*np.nonzero(data), strict=True)] if data.size else []
    if isinstance(data, Mapping):
        return [(int(r), int(c), float(v)) for (r, c), v in data.items()]
    if isinstance(data, Iterable):
        items = list(data)
        if not items:
            return []
        if all(isinstance(x, Mapping) for x in items):  # one dict for each vector
            stacked = [(i, int(r), int(c), float(v)) for i, x in enumerate(items) for (r, c), v in x.items()]
            if _are_columns(stacked, len(items), rows, columns):
                return [(r, i, v) for i, r, _, v in stacked]
            return [(i, c, v) for i, _, c, v in stacked]
        if all(hasattr(x, "tocoo") for x in items):  # sparse vectors, one for each observation
            return [(i, int(c), float(v)) for i, x in enumerate(items) for c, v in zip(x.tocoo().col, x.tocoo().data, strict=True)]
        if dense or all(isinstance(x, np.ndarray) for x in items):
            return [(r, c, float(v)) for r, x in enumerate(items) for c, v in enumerate(x) if v]
        if all(isinstance(x, list | tuple) and len(x) == 3 for x in items):
            return [(int(r), int(c), float(v)) for r, c, v in items]
    raise TableError(f"values of type {type(data).__name__} cannot be read as a matrix")


def example_table(spark: SparkSession) -> MatrixTable:
    """A small table to try things with."""
    obs, samp = [{"lineage": ["k__A", "p__B"]}, {"lineage": ["k__A", "p__C"]}], [{"site": "gut"}, {"site": "skin"}, {"site": "gut"}]
    return MatrixTable.from_data(spark, np.array([[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]), ["O1", "O2"], ["S1", "S2", "S3"], obs, samp)

"""Axis operators: ids, order, metadata, look-ups, equality."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparrix.errors import TableError, UnknownIDError
from sparrix.functions.scalar import natural_key

if TYPE_CHECKING:
    from sparrix.core import MatrixTable

#: Values of dense vectors that are made at once.
VALUES_AT_ONCE = 4_000_000


def _dense(n: int, kept: list[str]):
    """From (pos, value) pairs to dense vectors of ``n`` values, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VALUES_AT_ONCE // max(n, 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists = part["pairs"]
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), sizes)
                values = np.zeros(part.num_rows * n)
                values[row * n + flat.field("pos").to_numpy(zero_copy_only=False)] = flat.field("value").to_numpy(zero_copy_only=False)
                offsets = pa.array(np.arange(part.num_rows + 1) * n, pa.int32())
                yield pa.record_batch([*[part[c] for c in kept], pa.ListArray.from_arrays(offsets, pa.array(values))], names=[*kept, "values"])

    return run


def _mapped(n: int, f: Callable[[np.ndarray], tuple], schema: T.StructType):
    """From (pos, value) pairs to what ``f`` makes of dense vectors of ``n`` values; all are made in one place, one after the other."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.zeros(n)
        shown = values.view()
        shown.flags.writeable = False
        for batch in batches:
            lists = batch["pairs"]
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            pos, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "value"))
            found, lo = [], 0
            for hi in ends.tolist():
                values[pos[lo:hi]] = value[lo:hi]
                found.append(f(shown))
                values[pos[lo:hi]], lo = 0, hi
            yield pa.record_batch([batch["id"], *(pa.array([x[i] for x in found], k.type) for i, k in enumerate(list(kinds)[1:]))], schema=kinds)

    return run


class AxisOps:
    # -- ids and shape

    def ids(self, axis: str = "sample") -> DataFrame:
        """``(id)`` in the axis' order."""
        return self._axis(axis)[0].orderBy("ord").select("id")

    def positions(self, axis: str = "sample") -> DataFrame:
        """``(id, pos)``: positions from 0 without gaps."""
        from sparrix.core import renumbered

        return renumbered(self._axis(axis)[0].select("id", F.col("ord").alias("o")), "o").select("id", F.col("ord").alias("pos"))

    def exists(self, id_: Any, axis: str = "sample") -> bool:
        return not self._axis(axis)[0].where(F.col("id") == F.lit(id_)).isEmpty()

    def index(self, id_: Any, axis: str = "sample") -> int:
        frame, _ = self._axis(axis)
        found = frame.where(F.col("id") == F.lit(id_)).select("ord").first()
        if found is None:
            raise UnknownIDError(id_, axis)
        return frame.where(F.col("ord") < found[0]).count()

    def length(self, axis: str = "sample") -> int:
        return self._axis(axis)[0].count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.length("observation"), self.length("sample")

    def is_empty(self) -> bool:
        """True if either axis has no ids."""
        return self.obs.isEmpty() or self.samp.isEmpty()

    @property
    def dtype(self) -> str:
        return "double"

    @property
    def nnz(self) -> int:
        return self.cells.count()

    def density(self) -> float:
        rows, columns = self.shape
        return self.nnz / (rows * columns) if rows and columns else 0.0

    @property
    def matrix_data(self) -> DataFrame:
        return self.cells

    def __repr__(self) -> str:
        rows, columns = self.shape
        return f"{rows} x {columns} {type(self).__name__} with {self.nnz} nonzero entries ({int(self.density() * 100)}% dense)"

    def __str__(self) -> str:
        """The wide text of a table small enough for the driver."""
        from sparrix.sources.tsv import to_tsv

        return to_tsv(self)

    # -- metadata

    def has_metadata(self, axis: str) -> bool:
        return "md" in self._axis(axis)[0].columns

    def metadata(self, id_: Any = None, axis: str = "sample") -> DataFrame:
        """``(id, md.*)`` of all ids or of one; no rows where the axis has no metadata."""
        frame, _ = self._axis(axis)
        if id_ is not None:
            if not self.exists(id_, axis):
                raise UnknownIDError(id_, axis)
            frame = frame.where(F.col("id") == F.lit(id_))
        return frame.orderBy("ord").select("id", "md") if self.has_metadata(axis) else frame.select("id").limit(0)

    def add_metadata(self, md: DataFrame | Mapping[Any, Mapping[str, Any]], axis: str = "sample") -> MatrixTable:
        """Merges metadata by id; new values win, unknown ids are ignored.

        A frame holds ``id`` and a column for each key. Of several rows of an id the one
        with the greatest values is taken.
        """
        frame, _ = self._axis(axis)
        if not isinstance(md, DataFrame):
            from sparrix.core import axis_frame

            md = axis_frame(frame.sparkSession, list(md), list(md.values()))
            md = md.select(F.col("id").cast(frame.schema["id"].dataType), "md.*") if "md" in md.columns else md.select("id")
        keys = [c for c in md.columns if c != "id"]
        if not keys:
            return self
        one = md.groupBy("id").agg(F.max(F.struct(*keys)).alias("new"))
        joined = frame.join(one, "id", "left")
        old = frame.schema["md"].dataType.names if self.has_metadata(axis) else []
        both = [F.coalesce(F.col("new")[k], F.col("md")[k].cast(one.schema["new"].dataType[k].dataType)) if k in old else F.col("new")[k] for k in keys]
        kept = [F.col("md")[k].alias(k) for k in old if k not in keys]
        return self._with_axis(axis, joined.select("id", "ord", F.struct(*kept, *[c.alias(k) for c, k in zip(both, keys, strict=True)]).alias("md")))

    def del_metadata(self, keys: Sequence[str] | None = None, axis: str = "whole") -> MatrixTable:
        """Drops keys, or all metadata; an axis with none left has no metadata."""
        table = self
        for one in ("sample", "observation") if axis == "whole" else (axis,):
            frame, _ = table._axis(one)
            if not table.has_metadata(one):
                continue
            left = [] if keys is None else [k for k in frame.schema["md"].dataType.names if k not in keys]
            table = table._with_axis(one, frame.withColumn("md", F.struct(*[F.col("md")[k].alias(k) for k in left])) if left else frame.drop("md"))
        return table

    def group_metadata(self, axis: str = "sample") -> dict[str, tuple[str, str]]:
        self._axis(axis)
        return dict(self.props.samp_group_md if axis == "sample" else self.props.obs_group_md)

    def add_group_metadata(self, md: Mapping[str, tuple[str, str]], axis: str = "sample") -> MatrixTable:
        return self._new(**{"samp_group_md" if axis == "sample" else "obs_group_md": self.group_metadata(axis) | dict(md)})

    def metadata_columns(self, axis: str) -> DataFrame:
        """Metadata as columns; lists become ``key_0``, ``key_1`` and so on, up to the longest."""
        if not self.has_metadata(axis):
            raise KeyError(f"no {axis} metadata")
        frame, _ = self._axis(axis)
        fields = frame.schema["md"].dataType.fields
        lists = [f.name for f in fields if f.dataType.typeName() == "array"]
        sizes = frame.agg(*[F.max(F.size(F.col("md")[k])).alias(k) for k in lists]).first() if lists else {}
        columns = []
        for f in fields:
            if f.name in lists:
                columns += [F.get(F.col("md")[f.name], F.lit(i)).alias(f"{f.name}_{i}") for i in range(max(sizes[f.name] or 0, 0))]
            else:
                columns.append(F.col("md")[f.name].alias(f.name))
        return frame.orderBy("ord").select("id", *columns)

    # -- cells and vectors

    def value(self, obs_id: Any, samp_id: Any) -> float:
        """One cell, 0 where there is none."""
        for id_, axis in ((obs_id, "observation"), (samp_id, "sample")):
            if not self.exists(id_, axis):
                raise UnknownIDError(id_, axis)
        found = self.cells.where((F.col("obs_id") == F.lit(obs_id)) & (F.col("samp_id") == F.lit(samp_id))).select("value").first()
        return float(found[0]) if found else 0.0

    def data(self, id_: Any, axis: str = "sample", dense: bool = True) -> DataFrame:
        """``(id, ord, value)`` of one vector, along the other axis; dense with its zeros."""
        if not self.exists(id_, axis):
            raise UnknownIDError(id_, axis)
        _, key = self._axis(axis)
        other, other_key = self._axis(self._other(axis))
        cells = self.cells.where(F.col(key) == F.lit(id_)).select(F.col(other_key).alias("id"), "value")
        joined = other.select("id", "ord").join(cells, "id", "left" if dense else "inner")
        return joined.select("id", "ord", F.coalesce("value", F.lit(0.0)).alias("value"))

    def __getitem__(self, at: tuple[Any, Any]) -> float | DataFrame:
        """``[r, c]`` a value, ``[r, :]`` and ``[:, c]`` a dense vector, by position."""
        if not isinstance(at, tuple) or len(at) != 2:
            raise IndexError("a table is indexed by row and column")
        row, column = at
        for x in at:
            if isinstance(x, slice) and x != slice(None):
                raise IndexError("partial slices are not supported")
        if isinstance(row, slice) and isinstance(column, slice):
            raise IndexError("one of row and column must be a number")
        if isinstance(row, slice):
            return self.data(self._id_at(column, "sample"), "sample")
        if isinstance(column, slice):
            return self.data(self._id_at(row, "observation"), "observation")
        return self.value(self._id_at(row, "observation"), self._id_at(column, "sample"))

    def _id_at(self, pos: int, axis: str) -> Any:
        n = self.length(axis)
        if not -n <= pos < n:
            raise IndexError(f"{axis} {pos} of {n}")
        return self.positions(axis).where(F.col("pos") == pos % n).first()["id"]

    def vectors(self, axis: str = "sample", dense: bool = True) -> DataFrame:
        """``(id, ord, md, values)``: each vector packed in an array along the other axis.

        For callables only. Sparse arrays hold structs of ``id`` and ``value``.
        """
        frame, key = self._axis(axis)
        other, other_key = self._axis(self._other(axis))
        if dense:
            joined = self._with_pairs(axis)
            schema = T.StructType([*(joined.schema[c] for c in frame.columns), T.StructField("values", T.ArrayType(T.DoubleType()))])
            return joined.mapInArrow(_dense(other.count(), frame.columns), schema)
        order = other.select(F.col("id").alias(other_key), F.col("ord").alias("o"))
        packed = F.transform(F.sort_array(F.collect_list(F.struct("o", F.col(other_key).alias("id"), "value"))), lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value")))
        pairs = self.cells.join(order, other_key).groupBy(F.col(key).alias("id")).agg(packed.alias("values"))
        return frame.join(pairs, "id", "left")

    def _with_pairs(self, axis: str) -> DataFrame:
        """The axis with the non-zeros of each vector, as ``pairs`` of position and value."""
        frame, key = self._axis(axis)
        _, other_key = self._axis(self._other(axis))
        positions = self.positions(self._other(axis)).withColumnRenamed("id", other_key)
        pairs = self.cells.join(positions, other_key).groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct("pos", "value")).alias("pairs"))
        return frame.join(pairs, "id", "left").select(*frame.columns, "pairs")

    def map_vectors(self, f: Callable[[np.ndarray], tuple], returns: str, axis: str = "sample") -> DataFrame:
        """``(id, ...)``: what ``f`` returns of each dense vector, a tuple with the fields of ``returns``.

        A vector is whole only within the task that makes it, in a place that the next one
        takes: ``f`` sees all its values, and must copy what it keeps of them.
        """
        joined = self._with_pairs(axis).select("id", "pairs")
        schema = T.StructType([joined.schema["id"], *T._parse_datatype_string(returns)])
        return joined.mapInArrow(_mapped(self._axis(self._other(axis))[0].count(), f, schema), schema)

    def iter(self, axis: str = "sample", dense: bool = True) -> Iterator[tuple[Any, Any, Any]]:
        """Values, id and metadata of one vector after the other, in order."""
        for row in self.vectors(axis, dense).orderBy("ord").toLocalIterator():
            md = row["md"].asDict(recursive=True) if self.has_metadata(axis) and row["md"] is not None else None
            yield (np.array(row["values"]) if dense else [(x["id"], x["value"]) for x in row["values"] or []]), row["id"], md

    def iter_data(self, axis: str = "sample", dense: bool = True) -> Iterator[Any]:
        for values, _, _ in self.iter(axis, dense):
            yield values

    def __iter__(self) -> Iterator[tuple[Any, Any, Any]]:
        return self.iter()

    def nonzero(self) -> DataFrame:
        """``(obs_id, samp_id)`` of the non-zero cells, row by row."""
        o = self.obs.select(F.col("id").alias("obs_id"), F.col("ord").alias("o"))
        s = self.samp.select(F.col("id").alias("samp_id"), F.col("ord").alias("s"))
        return self.cells.join(o, "obs_id").join(s, "samp_id").orderBy("o", "s").select("obs_id", "samp_id")

    # -- order and names

    def transpose(self) -> MatrixTable:
        cells = self.cells.select(F.col("samp_id").alias("obs_id"), F.col("obs_id").alias("samp_id"), "value")
        p = self.props
        return self._new(cells, self.samp, self.obs, obs_group_md=p.samp_group_md, samp_group_md=p.obs_group_md)

    def copy(self) -> MatrixTable:
        return self._new()

    def update_ids(self, mapping: Mapping[Any, Any] | DataFrame, axis: str = "sample", strict: bool = True) -> MatrixTable:
        """Renames ids. ``strict`` wants a new id for each; duplicates are an error.

        A frame holds ``id`` and ``new_id``.
        """
        frame, key = self._axis(axis)
        if not isinstance(mapping, DataFrame):
            if not mapping:
                raise ValueError("the mapping is empty")
            mapping = frame.sparkSession.createDataFrame([(a, str(b)) for a, b in mapping.items()], f"id {frame.schema['id'].dataType.simpleString()}, new_id string")
        mapping = mapping.select("id", "new_id")
        if strict and (missing := frame.join(mapping, "id", "left_anti").select("id").first()):
            raise TableError(f"no new id for {axis} {missing[0]!r}")
        renamed = F.coalesce("new_id", F.col("id").cast("string"))
        new = frame.join(mapping, "id", "left").withColumn("id", renamed).drop("new_id")
        if not new.groupBy("id").count().where("count > 1").isEmpty():
            raise TableError("duplicate ids observed")
        cells = self.cells.join(mapping.withColumnRenamed("id", key), key, "left").withColumn(key, F.coalesce("new_id", F.col(key).cast("string"))).drop("new_id")
        return self._with_axis(axis, new.select(*frame.columns), cells.select("obs_id", "samp_id", "value"))

    def sort_order(self, order: Sequence[Any] | DataFrame, axis: str = "sample") -> MatrixTable:
        """Puts an axis in the given order; ids that are not in it are dropped.

        A frame holds ``id`` and ``ord``.
        """
        frame, key = self._axis(axis)
        if not isinstance(order, DataFrame):
            order = frame.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], f"id {frame.schema['id'].dataType.simpleString()}, ord long")
            if missing := order.join(frame, "id", "left_anti").first():
                raise UnknownIDError(missing["id"], axis)
        new = frame.drop("ord").join(order.select("id", "ord"), "id").select(*frame.columns)
        return self._with_axis(axis, new, self.cells.join(new.select(F.col("id").alias(key)), key, "left_semi").select("obs_id", "samp_id", "value"))

    def sort(self, key: Callable[[Column], Column] | None = None, axis: str = "sample") -> MatrixTable:
        """Sorts an axis by a key column of its ids; by default, naturally."""
        from sparrix.core import renumbered

        frame, _ = self._axis(axis)
        return self._with_axis(axis, renumbered(frame.drop("ord"), (key or natural_key)(F.col("id")), "id").select(*frame.columns))

    def sort_with(self, f: Callable[[list[Any]], Sequence[Any]], axis: str = "sample") -> MatrixTable:
        """Puts an axis in the order in which ``f`` returns the list of its ids, which the driver holds."""
        return self.sort_order(f([r["id"] for r in self.ids(axis).collect()]), axis)

    def values(self, keys: DataFrame) -> DataFrame:
        """``(obs_id, samp_id, value)`` of many cells at once, 0 where there is none; null where an id is unknown."""
        known = keys.select("obs_id", "samp_id").distinct()
        for axis, key in (("observation", "obs_id"), ("sample", "samp_id")):
            known = known.join(self._axis(axis)[0].select(F.col("id").alias(key), F.lit(True).alias(f"has_{key}")), key, "left")
        found = known.join(self.cells, ["obs_id", "samp_id"], "left")
        return found.select("obs_id", "samp_id", F.when(F.col("has_obs_id") & F.col("has_samp_id"), F.coalesce("value", F.lit(0.0))).alias("value"))

    # -- equality

    def differences(self, other: MatrixTable) -> str:
        """What differs first: ``type``, ids, metadata or ``cells``; an empty text if nothing does.

        Both tables are joined by id, nothing is gathered. Metadata that is null and
        metadata that is absent are equal.
        """
        if self.props.type != other.props.type:
            return "type"
        for axis in ("observation", "sample"):
            mine, theirs = (t.positions(axis).toDF("id", p) for t, p in ((self, "p"), (other, "q")))
            if not mine.join(theirs, "id", "full").where(~F.col("p").eqNullSafe(F.col("q"))).isEmpty():
                return f"{axis} ids"
            mine, theirs = (t._md_texts(axis).toDF("id", p) for t, p in ((self, "p"), (other, "q")))
            if not mine.join(theirs, "id").where(~F.col("p").eqNullSafe(F.col("q"))).isEmpty():
                return f"{axis} metadata"
        return "" if self._same_cells(other) else "cells"

    def _md_texts(self, axis: str) -> DataFrame:
        frame, _ = self._axis(axis)
        if not self.has_metadata(axis):
            return frame.select("id", F.lit("{}").alias("text"))
        keys = sorted(frame.schema["md"].dataType.names)
        return frame.select("id", F.to_json(F.struct(*[F.col("md")[k].alias(k) for k in keys])).alias("text"))

    def _same_cells(self, other: MatrixTable) -> bool:
        mine = self.cells.select("obs_id", "samp_id", F.col("value").alias("p"))
        theirs = other.cells.select("obs_id", "samp_id", F.col("value").alias("q"))
        return mine.join(theirs, ["obs_id", "samp_id"], "full").where(~F.col("p").eqNullSafe(F.col("q"))).isEmpty()

    def equals(self, other: object) -> bool:
        """Equal in type, ids and their order, metadata and values."""
        return isinstance(other, AxisOps) and not self.differences(other)

    def __eq__(self, other: object) -> bool:
        return self.equals(other)

    __hash__ = object.__hash__

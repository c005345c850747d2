"""The HDF5 table format 2.1, where h5py is installed.

Layout: per axis the ids, metadata by key, group metadata, and the matrix in compressed
rows (observations) and compressed columns (samples). The driver reads the axes and where
each vector begins; the values are read by the tasks, a range of vectors each, from the
orientation whose ids are asked for, so only wanted ranges are read. The file must be in a
folder that all executors see under the same path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix.core import MatrixTable, Props, axis_frame
from sparrix.errors import SparrixError

SLASH = "@@SLASH@@"


def _h5py() -> Any:
    try:
        import h5py
    except ImportError as e:
        raise SparrixError("HDF5 tables need h5py, which is not installed") from e
    return h5py


def text(x: Any) -> Any:
    return x.decode("utf-8") if isinstance(x, bytes) else x


def list_of_text(x: Any) -> list[str] | None:
    """A list of texts without its empty filling; none if nothing is left."""
    items = [text(v) for v in x if text(v)]
    return items or None


def _metadata(group: Any, n: int, parse: Mapping[str, Callable[[Any], Any]]) -> list[dict[str, Any]] | None:
    keys = list(group.keys()) if group is not None else []
    if not keys:
        return None
    columns = {k.replace(SLASH, "/"): group[k][()] for k in keys}

    def one(key: str, column: Any, i: int) -> Any:
        if key in parse:
            return parse[key](column[i])
        return list_of_text(column[i]) if getattr(column, "ndim", 1) > 1 else text(_plain(column[i]))

    return [{k: one(k, c, i) for k, c in columns.items()} for i in range(n)]


def _plain(x: Any) -> Any:
    return x.item() if isinstance(x, np.generic) else x


#: Values that a task reads at once.
VALUES_AT_ONCE = 1_000_000


def read_hdf5(
    spark: SparkSession, path: str, ids: list[str] | None = None, axis: str = "sample", metadata: bool = True, parse: Mapping[str, Callable[[Any], Any]] | None = None,
) -> MatrixTable:
    """The table, or its part with the given ids, whose ranges alone are read.

    parse: for metadata keys, functions that make a value of what is stored for one id.
    """
    with _h5py().File(path, "r") as f:
        obs, samp = ([text(x) for x in f[a]["ids"][()]] for a in ("observation", "sample"))
        md = [_metadata(f[a].get("metadata"), len(x), parse or {}) if metadata else None for a, x in (("observation", obs), ("sample", samp))]
        major = samp if axis == "sample" else obs
        if ids is not None and (missing := set(ids) - set(major)):
            raise ValueError(f"unknown {axis} ids: {sorted(missing)[:3]}")
        indptr = f[axis]["matrix"]["indptr"][()].astype(np.int64)
        attrs = {k: text(_plain(v)) if not isinstance(v, np.ndarray) else v.tolist() for k, v in f.attrs.items()}
        groups = [_group_metadata(f[a].get("group-metadata")) for a in ("observation", "sample")]
    wanted = range(len(major)) if ids is None else [i for i, x in enumerate(major) if x in set(ids)]
    date = None
    try:
        date = datetime.fromisoformat(attrs.get("creation-date", ""))
    except (TypeError, ValueError):
        pass
    props = Props(attrs.get("id"), attrs.get("type"), date, attrs.get("generated-by"), tuple(attrs.get("format-version", (2, 1))), *groups)
    frames = {"observation": axis_frame(spark, obs, md[0]), "sample": axis_frame(spark, samp, md[1])}
    ranges = spark.createDataFrame([(int(i), int(indptr[i]), int(indptr[i + 1])) for i in wanted if indptr[i] < indptr[i + 1]], "i long, lo long, hi long")
    cells = ranges.mapInArrow(_values_of(path, axis), "i long, j long, value double").where("value <> 0")
    names = ("samp_id", "obs_id") if axis == "sample" else ("obs_id", "samp_id")
    for place, name, of in (("i", names[0], axis), ("j", names[1], "observation" if axis == "sample" else "sample")):
        cells = cells.join(frames[of].select(F.col("ord").alias(place), F.col("id").alias(name)), place)
    table = MatrixTable(cells.select("obs_id", "samp_id", "value"), frames["observation"], frames["sample"], props)
    if ids is None:
        return table
    frame, _ = table._axis(axis)
    table = table._with_axis(axis, frame.where(F.col("id").isin(ids)))
    other = table._other(axis)
    return table._semi(other, table.cells.select(F.col(table._axis(other)[1]).alias("id")).distinct(), False)


def _values_of(path: str, axis: str):
    """Reads the values of ranges (i, lo, hi) of an orientation, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py().File(path, "r") as f:
            matrix = f[axis]["matrix"]
            for batch in batches:
                for i, lo, hi in zip(*(batch[c].to_pylist() for c in ("i", "lo", "hi")), strict=True):
                    for a in range(lo, hi, VALUES_AT_ONCE):
                        b = min(hi, a + VALUES_AT_ONCE)
                        columns = [np.full(b - a, i, np.int64), matrix["indices"][a:b].astype(np.int64), matrix["data"][a:b].astype(float)]
                        yield pa.record_batch([pa.array(x) for x in columns], names=["i", "j", "value"])

    return run


def _group_metadata(group: Any) -> dict[str, tuple[str, str]]:
    return {k: (text(d.attrs.get("data_type", "")), text(d[()] if d.shape == () else d[0])) for k, d in group.items()} if group is not None else {}


def write_hdf5(table: MatrixTable, path: str, generated_by: str, compress: bool = True, formats: Mapping[str, Callable[[Any], Any]] | None = None) -> None:
    """Both orientations, compressed; one process writes a file, value block by value block.

    Metadata of an axis has the same keys for all ids. formats: for metadata keys, functions
    that make of an id's value a text or a list of texts. A text with separators under the
    key ``taxonomy`` is stored as the list of its parts.
    """
    formats = {"taxonomy": _parted} | dict(formats or {})
    h5py = _h5py()
    options = {"compression": "gzip"} if compress else {}
    p = table.props
    with h5py.File(path, "w") as f:
        f.attrs.update({
            "id": p.table_id or "No Table ID", "type": p.type or "", "format-url": "", "format-version": (2, 1), "generated-by": generated_by,
            "creation-date": (p.create_date or datetime.now()).isoformat(), "shape": table.shape, "nnz": (nnz := table.nnz),
        })
        o, s = table.positions("observation").toDF("obs_id", "r"), table.positions("sample").toDF("samp_id", "c")
        placed = table.cells.join(o, "obs_id").join(s, "samp_id").select("r", "c", "value")
        for axis, major, minor, group_md in (("observation", "r", "c", p.obs_group_md), ("sample", "c", "r", p.samp_group_md)):
            group, rows = f.create_group(axis), table._axis(axis)[0].orderBy("ord").collect()
            group.create_dataset("ids", data=[str(r["id"]) for r in rows], dtype=h5py.string_dtype(), **options)
            matrix = group.create_group("matrix")
            counts = np.zeros(len(rows), np.int64)
            data, indices = (matrix.create_dataset(name, shape=(nnz,), dtype=kind, **options) for name, kind in (("data", "f8"), ("indices", "i4")))
            at = 0
            for block in _blocks(placed.orderBy(major, minor).select(major, minor, "value")):
                n = len(block)
                data[at : at + n], indices[at : at + n] = block[:, 2], block[:, 1].astype(np.int32)
                counts += np.bincount(block[:, 0].astype(np.int64), minlength=len(rows))
                at += n
            matrix.create_dataset("indptr", data=np.concatenate(([0], np.cumsum(counts))).astype(np.int32), **options)
            md = group.create_group("metadata")
            for key in table._axis(axis)[0].schema["md"].dataType.names if table.has_metadata(axis) else []:
                values = [r["md"][key] if r["md"] is not None else None for r in rows]
                values = [formats[key](v) if key in formats and v is not None else v for v in values]
                name = key.replace("/", SLASH)
                if any(isinstance(v, list) for v in values):
                    width = max(len(v or []) for v in values)
                    filled = [[str(x) for x in v or []] + [""] * (width - len(v or [])) for v in values]
                    md.create_dataset(name, data=np.array(filled, object), dtype=h5py.string_dtype(), **options)
                else:
                    md.create_dataset(name, data=["" if v is None else str(v) for v in values], dtype=h5py.string_dtype(), **options)
            extra = group.create_group("group-metadata")
            for key, (kind, value) in group_md.items():
                extra.create_dataset(key, data=value, dtype=h5py.string_dtype()).attrs["data_type"] = kind


def _parted(value: Any) -> Any:
    return [x.strip() for x in value.split(";")] if isinstance(value, str) and ";" in value else value


def _blocks(df: DataFrame) -> Iterator[np.ndarray]:
    """The rows of a frame of numbers, block by block, as they arrive."""
    held: list[tuple] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) >= VALUES_AT_ONCE:
            yield np.array(held, float)
            held = []
    if held:
        yield np.array(held, float)

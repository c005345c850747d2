"""The native layout: a folder of Parquet tables and a file of properties."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparrix.core import MatrixTable, Props


def write_parquet(table: MatrixTable, path: str, by: str = "sample", both: bool = False, mode: str = "errorifexists") -> None:
    """Cells sorted by an axis, so that a scan for some of its ids skips row groups.

    With ``both``, a second copy is sorted by the other axis.
    """
    for axis in (by, table._other(by)) if both else (by,):
        _, key = table._axis(axis)
        table.cells.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(f"{path}/cells_by_{axis}")
    table.obs.write.mode(mode).parquet(f"{path}/obs")
    table.samp.write.mode(mode).parquet(f"{path}/samp")
    p = table.props
    props = {
        "table_id": p.table_id, "type": p.type, "create_date": p.create_date.isoformat() if p.create_date else None, "generated_by": p.generated_by,
        "format_version": list(p.format_version), "obs_group_md": dict(p.obs_group_md), "samp_group_md": dict(p.samp_group_md), "by": by, "both": both,
    }
    table.cells.sparkSession.createDataFrame([(json.dumps(props),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/props")


def read_parquet(spark: SparkSession, path: str, ids: list | None = None, axis: str = "sample") -> MatrixTable:
    """The table, or its part with the given ids; the filter reaches the scan of the cells.

    Unknown ids are an error; vectors of the other axis that lose all cells are dropped.
    """
    p = json.loads(spark.read.text(f"{path}/props").first()[0])
    props = Props(
        p["table_id"], p["type"], datetime.fromisoformat(p["create_date"]) if p["create_date"] else None, p["generated_by"], tuple(p["format_version"]),
        {k: tuple(v) for k, v in p["obs_group_md"].items()}, {k: tuple(v) for k, v in p["samp_group_md"].items()},
    )
    by = axis if ids is not None and p["both"] else p["by"]
    table = MatrixTable(spark.read.parquet(f"{path}/cells_by_{by}"), spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/samp"), props)
    if ids is None:
        return table
    frame, key = table._axis(axis)
    if missing := spark.createDataFrame([(i,) for i in ids], f"id {frame.schema['id'].dataType.simpleString()}").join(frame, "id", "left_anti").first():
        raise ValueError(f"unknown {axis} id {missing[0]!r}")
    part = table._with_axis(axis, frame.where(F.col("id").isin(ids)), table.cells.where(F.col(key).isin(ids)))
    other = part._other(axis)
    _, other_key = part._axis(other)
    return part._semi(other, part.cells.select(F.col(other_key).alias("id")).distinct(), False)

"""The JSON table format 1.0: one document for a table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.core import MatrixTable, Props
from sparrix.errors import ParseError, UnknownIDError
from sparrix.runtime import materialize
from sparrix.sources.files import text_file
from sparrix.sources.json_parts import Parts, is_large, read_parts

# Fixed value of the format.
FORMAT_VERSION = "1.0.0"
#: What a written document names as the address of its format; any text that is not empty conforms.
FORMAT_URL = "urn:sparrix:json-table:1.0"

AXIS = "array<struct<id: string, metadata: string>>"
#: The parts of a document; metadata stays JSON text, so that its shape is free.
DOCUMENT = (
    f"id string, format string, format_url string, type string, generated_by string, date string, matrix_type string, matrix_element_type string, "
    f"shape array<int>, data array<array<double>>, rows {AXIS}, columns {AXIS}"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document of a path, only its columns that are used being parsed."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def read_json(spark: SparkSession, source: str | dict[str, Any], input_is_dense: bool | None = None) -> MatrixTable:
    """A table from a document's path, text or parsed form.

    Cells repeated in the data are added. Metadata keeps its types. A large document is
    read in parts.
    """
    if isinstance(source, dict):
        return _from_object(spark, source, input_is_dense)
    if source.lstrip().startswith("{"):
        return _from_object(spark, json.loads(source), input_is_dense)
    if is_large(source) and (parts := read_parts(spark, source)):
        return _from_parts(spark, parts, source, input_is_dense)
    doc = read_documents(spark, source)
    head = doc.select("id", "type", "generated_by", "date", "matrix_type").first()
    if head is None:
        raise ParseError(f"no JSON document in {source}")
    dense = head["matrix_type"] == "dense" if input_is_dense is None else input_is_dense
    obs, samp = (_axis_rows(doc.select(F.posexplode(c).alias("ord", "x"))) for c in ("rows", "columns"))
    return _from_entries(doc.select(F.posexplode("data").alias("r", "t")), obs, samp, dense, head.asDict())


def _from_parts(spark: SparkSession, parts: Parts, source: str, input_is_dense: bool | None) -> MatrixTable:
    try:
        doc = json.loads(parts.text, strict=False)
    except ValueError as e:
        raise ParseError(f"no JSON document in {source}") from e
    head = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in doc.items() if k in ("id", "type", "generated_by", "date", "matrix_type")}
    parsed = lambda kind: F.coalesce(F.from_json("text", kind), F.raise_error(F.concat(F.lit("an entry cannot be read: "), F.left("text", F.lit(99)))))
    entries = materialize(parts.entries("rows", "columns"), "axes").withColumn("x", parsed("struct<id: string, metadata: string>"))
    obs, samp = (_axis_rows(entries.where(F.col("list") == c)) for c in ("rows", "columns"))
    few = {k: n <= FEW_IDS for k, n in parts.sizes.items()}
    data = parts.entries("data").select(F.col("ord").alias("r"), parsed("array<double>").alias("t"))
    return _from_entries(data, obs, samp, head.get("matrix_type") == "dense" if input_is_dense is None else input_is_dense, head, few)


def _from_entries(data: DataFrame, obs: DataFrame, samp: DataFrame, dense: bool, head: dict[str, Any], few: dict[str, bool] | None = None) -> MatrixTable:
    """data: the list ``t`` at each place ``r``. few: the axes whose ids are sent to all tasks."""
    if dense:
        long = data.select(F.col("r").cast("int").alias("r"), F.posexplode("t").alias("c", "value"))
    else:
        long = data.select(F.get("t", F.lit(0)).cast("int").alias("r"), F.get("t", F.lit(1)).cast("int").alias("c"), F.get("t", F.lit(2)).alias("value"))
    r, c = obs.select(F.col("ord").cast("int").alias("r"), F.col("id").alias("obs_id")), samp.select(F.col("ord").cast("int").alias("c"), F.col("id").alias("samp_id"))
    r, c = (F.broadcast(df) if (few or {}).get(k) else df for k, df in (("rows", r), ("columns", c)))
    cells = long.join(r, "r").join(c, "c")
    return MatrixTable.from_triples(cells, obs_axis=obs, samp_axis=samp, props=_props(head))


def _axis_rows(entries: DataFrame) -> DataFrame:
    rows = entries.select(F.col("x.id").alias("id"), F.col("ord").cast("long").alias("ord"), F.col("x.metadata").alias("json"))
    schema = _schema_of(rows)
    return rows.select("id", "ord", F.from_json("json", schema).alias("md")) if schema else rows.select("id", "ord")


def _schema_of(rows: DataFrame) -> str | None:
    """The type of all metadata, merged in the cluster; what has several types is text."""
    found = rows.agg(F.schema_of_variant_agg(F.try_parse_json("json"))).first()[0] or ""
    if not found.startswith("OBJECT<") or found == "OBJECT<>":
        return None
    for variant, plain in (("OBJECT<>", "STRING"), ("OBJECT<", "STRUCT<"), ("VARIANT", "STRING"), ("VOID", "STRING")):
        found = found.replace(variant, plain)
    return re.sub(r"DECIMAL\(\d+,\s*\d+\)|FLOAT", "DOUBLE", found)


def _props(head: dict[str, Any]) -> Props:
    date = None
    if head.get("date"):
        try:
            date = datetime.fromisoformat(head["date"])
        except ValueError:
            pass
    return Props(table_id=head.get("id"), type=head.get("type"), create_date=date, generated_by=head.get("generated_by"), format_version=(1, 0))


def _from_object(spark: SparkSession, doc: dict[str, Any], dense: bool | None) -> MatrixTable:
    dense = doc.get("matrix_type") == "dense" if dense is None else dense
    obs, samp = ([x["id"] for x in doc[k]] for k in ("rows", "columns"))
    md = [[x.get("metadata") for x in doc[k]] for k in ("rows", "columns")]
    return MatrixTable.from_data(spark, doc["data"], obs, samp, md[0], md[1], _props(doc), input_is_dense=dense)


def _head(table: MatrixTable, shape: tuple[int, int], generated_by: str, date: datetime | None) -> str:
    p = table.props
    head = {
        "id": p.table_id, "format": FORMAT_VERSION, "format_url": FORMAT_URL, "type": p.type, "generated_by": generated_by, "date": (date or p.create_date or datetime.now()).isoformat(),
        "matrix_type": "sparse", "matrix_element_type": "float", "shape": list(shape),
    }
    return json.dumps(head, ensure_ascii=False)[:-1]


#: Positions of an axis of up to so many ids are sent to all tasks.
FEW_IDS = 200_000


def _sections(table: MatrixTable, shape: tuple[int, int]) -> Iterator[tuple[str, DataFrame, list[str], Column]]:
    """Name, frame, order and text of the document's lists; values have six decimals."""
    o, s = (F.broadcast(df) if n <= FEW_IDS else df for df, n in zip((table.positions("observation").toDF("obs_id", "r"), table.positions("sample").toDF("samp_id", "c")), shape, strict=True))
    yield "data", table.cells.join(o, "obs_id").join(s, "samp_id").select("r", "c", "value"), ["r", "c"], F.format_string("[%d,%d,%f]", "r", "c", "value")
    for key, axis in (("rows", "observation"), ("columns", "sample")):
        md = F.coalesce(F.to_json("md", {"ignoreNullFields": "false"}), F.lit("null")) if table.has_metadata(axis) else F.lit("null")
        quoted = F.substring(F.to_json(F.struct(F.col("id").cast("string").alias("k"))), 6, 1 << 30)  # {"k":"..."}
        entry = F.concat(F.lit('{"id": '), F.expr("left(q, length(q) - 1)"), F.lit(', "metadata": '), md, F.lit("}"))
        yield key, table._axis(axis)[0].withColumn("q", quoted).select("ord", entry.alias("x")), ["ord"], F.col("x")


def to_json(table: MatrixTable, generated_by: str, date: datetime | None = None) -> str:
    """The document of a table small enough for the driver."""
    shape = table.shape
    lists = [f'"{name}": [{",".join(r["x"] for r in df.orderBy(*order).select(x.alias("x")).toLocalIterator())}]' for name, df, order, x in _sections(table, shape)]
    return f"{_head(table, shape, generated_by, date)}, {', '.join(lists)}}}"


def write_json(table: MatrixTable, path: str, generated_by: str, date: datetime | None = None) -> None:
    """One file; its lists are written by the tasks in parts and put together."""
    shape = table.shape
    with text_file(path) as out:
        out.text(_head(table, shape, generated_by, date))
        for name, df, order, x in _sections(table, shape):
            out.text(f', "{name}": [')
            out.rows(df, order, x, listed=True)
            out.text("]")
        out.text("}\n")


def field(spark: SparkSession, path: str, key: str) -> Any:
    """One top-level field of a document; the others are not parsed."""
    schema = T._parse_datatype_string(DOCUMENT)
    return spark.read.schema(T.StructType([schema[key]])).json(path, multiLine=True).first()[0]


def subset(table: MatrixTable, ids: Iterable[Any], axis: str) -> MatrixTable:
    """The table with the given ids of an axis; unknown ids are an error."""
    ids = list(ids)
    try:
        return table.filter(ids, axis)
    except UnknownIDError as e:
        raise KeyError(str(e)) from e



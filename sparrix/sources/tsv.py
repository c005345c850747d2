"""Wide tab-separated tables: observations down, samples across, metadata in a last column."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparrix.core import MatrixTable, Props, axis_frame, renumbered
from sparrix.errors import ParseError, TableError
from sparrix.functions.scalar import is_number
from sparrix.sources.files import text_file
from sparrix.sources.lines import read_lines

#: The fields of a header are broadcast up to this number.
LISTED = 100_000


def _header(lines: DataFrame) -> tuple[list[str], object]:
    """The header's fields and the number of its line.

    It is the last ``#`` line before the data if that has several fields, otherwise the
    first line that does not begin with ``#``. Both come from aggregates, nothing is sorted.
    """
    at = F.struct("line_no", "line")
    comment = F.col("line").startswith("#")
    first = lines.where((F.trim("line") != "") & ~comment).agg(F.min(at)).first()[0]
    if first is None:
        raise ParseError("the file has no data")
    last = lines.where(comment & (F.col("line_no") < _place(first["line_no"]))).agg(F.max(at)).first()[0]
    if last is not None and "\t" in last["line"]:
        return last["line"].lstrip("#").split("\t"), last["line_no"]
    return first["line"].split("\t"), first["line_no"]


def _place(line_no: Row) -> Column:
    return F.struct(*[F.lit(line_no[k]).alias(k) for k in ("f", "b", "m")])


def read_tsv(
    spark: SparkSession, source: str | Iterable[str], obs_mapping: DataFrame | None = None, sample_mapping: DataFrame | None = None, process: Callable[[Column], Column] | None = None, md_name: str | None = None,
) -> MatrixTable:
    """A wide table. A last column with text is observation metadata, under its header's name.

    Lines that begin with ``#`` and blank ones are skipped. A value that is no number is an
    error that names line and column. ``process`` makes metadata of the column's text.
    Mapping frames hold ``id`` and metadata columns; all ids must be in them.
    """
    lines = read_lines(spark, source)
    fields, header_no = _header(lines)
    after = (F.col("line_no") > _place(header_no)) & ~F.col("line").startswith("#")
    parts = F.split("line", "\t")
    rows = lines.where(after & (F.trim("line") != "")).select("line_no", parts.alias("p")).withColumn("id", F.trim(F.get("p", F.lit(0))))
    n = len(fields) - 1
    numeric = rows.agg(F.min(F.coalesce(is_number(F.get("p", F.lit(n))), F.lit(False)))).first()[0]
    has_md = not numeric and n > 0
    samples = [s.strip() for s in fields[1 : n if has_md else n + 1]]
    wide = rows.select("id", "line_no", F.slice("p", 2, len(samples)).alias("v"), F.get("p", F.lit(n)).alias("text"))
    obs = renumbered(wide.select("id", "line_no", "text"), "line_no")
    if has_md:
        name = md_name or fields[-1].strip()
        obs = obs.select("id", "ord", F.struct((process or F.trim)(F.col("text")).alias(name)).alias("md"))
    else:
        obs = obs.select("id", "ord")
    samp = axis_frame(spark, samples)
    long = wide.select("id", "line_no", F.posexplode("v").alias("pos", "text"))
    number = F.trim("text").try_cast("double")
    message = F.format_string("not a number in the row of %s, column %s: %s", F.col("id"), (F.col("pos") + 2).cast("string"), F.col("text"))
    cells = long.select(F.col("id").alias("obs_id"), "pos", F.when(number.isNull(), F.raise_error(message)).otherwise(number).cast("double").alias("value")).where("value <> 0")
    names = samp.select(F.col("ord").alias("pos"), F.col("id").alias("samp_id"))
    names = F.broadcast(names) if len(samples) <= LISTED else names
    table = MatrixTable(cells.join(names, "pos").select("obs_id", "samp_id", "value"), obs, samp, Props())
    for mapping, axis in ((obs_mapping, "observation"), (sample_mapping, "sample")):
        if mapping is not None:
            if missing := table._axis(axis)[0].join(mapping, "id", "left_anti").select("id").first():
                raise KeyError(missing[0])
            table = table.add_metadata(mapping, axis)
    return table


def tsv_lines(
    table: MatrixTable, header_key: str | None = None, header_value: str | None = None, formatter: Callable[[Column], Column] | None = None, column_name: str = "#OTU ID", delim: str = "\t",
) -> DataFrame:
    """``(ord, line)``: the lines of a wide table, without its header.

    With ``header_key``, that observation metadata stands in a last column, formatted; by
    default lists are joined with ``; ``.
    """
    if table.is_empty():
        raise TableError("an empty table cannot be written as text")
    joined = table.vectors("observation")
    value = F.transform("values", lambda x: x.cast("string"))
    parts = [F.col("id").cast("string"), F.array_join(value, delim)]
    if header_key is not None:
        md = F.col("md")[header_key] if table.has_metadata("observation") and header_key in table.obs.schema["md"].dataType.names else F.lit(None).cast("string")
        kind = table.obs.schema["md"].dataType[header_key].dataType.typeName() if table.has_metadata("observation") else "string"
        text = formatter(md) if formatter else F.array_join(md, "; ") if kind == "array" else md.cast("string")
        parts.append(F.coalesce(text, F.lit("None")))
    return joined.select("ord", F.concat_ws(delim, *parts).alias("line"))


def tsv_header(table: MatrixTable, header_key: str | None = None, header_value: str | None = None, column_name: str = "#OTU ID", delim: str = "\t") -> list[str]:
    ids = [str(r["id"]) for r in table.ids("sample").collect()]  # one line of output
    last = [header_value or header_key] if header_key is not None else []
    return ["# Constructed from a sparse table", delim.join([column_name, *ids, *last])]


def to_tsv(table: MatrixTable, header_key: str | None = None, header_value: str | None = None, formatter: Callable[[Column], Column] | None = None, column_name: str = "#OTU ID", delim: str = "\t") -> str:
    """A table small enough for the driver, as text."""
    lines = tsv_lines(table, header_key, header_value, formatter, column_name, delim).orderBy("ord")
    return "\n".join([*tsv_header(table, header_key, header_value, column_name, delim), *(r["line"] for r in lines.toLocalIterator())])


def write_tsv(table: MatrixTable, path: str, **options) -> None:
    """One file; its lines are written by the tasks in parts and put together."""
    lines = tsv_lines(table, **options)
    header = {k: v for k, v in options.items() if k != "formatter"}
    with text_file(path) as out:
        out.text("".join(f"{line}\n" for line in tsv_header(table, **header)))
        out.rows(lines, ["ord"], "line")


def write_tsv_parts(table: MatrixTable, path: str, **options) -> None:
    """A folder of text files in order, written by the tasks; the header is in ``_header``."""
    tsv_lines(table, **options).repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.text(path)


def first_bad_value(spark: SparkSession, fields: list[str]) -> tuple[str, int] | None:
    """The first field that is no number, and its place."""
    df = spark.createDataFrame(list(enumerate(fields)), "i int, text string")
    bad = df.where(~F.coalesce(is_number(F.col("text")), F.lit(False))).orderBy("i").first()
    return (bad["text"], bad["i"]) if bad else None

"""Finding out the format of a file, and reading and writing by format."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from sparrix.errors import ParseError
from sparrix.runtime import work_path
from sparrix.sources.files import blocks, copy, exists, first_bytes, is_folder, md5_of, size_of

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

    from sparrix.core import MatrixTable

GENERATED_BY = "sparrix"


def is_gzip(path: str) -> bool:
    return first_bytes(path, 2) == b"\x1f\x8b"


def is_hdf5(path: str) -> bool:
    return first_bytes(path, 8) == b"\x89HDF\r\n\x1a\n"


def sniff(path: str) -> str:
    """parquet (a folder), hdf5, json or tsv, by content."""
    if is_folder(path):
        return "parquet"
    if not size_of(path):
        raise ValueError(f"{path} is empty")
    if is_hdf5(path):
        return "hdf5"
    for block in blocks(path, is_gzip(path)):
        if text := block.lstrip():
            return "json" if text.startswith(b"{") else "tsv"
    raise ValueError(f"{path} is blank")


def read_matrix(spark: SparkSession, path: str, format: str | None = None, ids: Iterable[Any] | None = None, axis: str = "sample") -> MatrixTable:  # noqa: A002
    """A table of any format. With ``ids`` only these are kept, and vectors of the other axis that still have a cell."""
    from sparrix.sources import hdf5, json_table, parquet, tsv

    kind = format or sniff(path)
    ids = list(ids) if ids is not None else None
    if kind == "parquet":
        return parquet.read_parquet(spark, path, ids, axis)
    if kind == "hdf5":
        return hdf5.read_hdf5(spark, path, ids, axis)
    if kind not in ("json", "tsv"):
        raise ParseError(f"unknown format {kind!r}")
    named = path
    if not path.endswith(".gz") and exists(path) and not is_folder(path) and is_gzip(path):
        named = work_path(spark, "file") + ".gz"  # Spark goes by the name
        copy(path, named)
    table = json_table.read_json(spark, named) if kind == "json" else tsv.read_tsv(spark, named)
    if ids is None:
        return table
    table = table.filter(ids, axis)
    other = table._other(axis)
    return table._semi(other, table.cells.select(table.cells[table._axis(other)[1]].alias("id")).distinct(), False)


def write_matrix(table: MatrixTable, path: str, format: str = "parquet", generated_by: str = GENERATED_BY, **options: Any) -> None:  # noqa: A002
    from sparrix.sources import hdf5, json_table, parquet, tsv

    if format == "parquet":
        parquet.write_parquet(table, path, **options)
    elif format == "json":
        json_table.write_json(table, path, generated_by)
    elif format == "tsv":
        tsv.write_tsv(table, path, **options)
    elif format == "hdf5":
        hdf5.write_hdf5(table, path, generated_by, **options)
    else:
        raise ValueError(f"unknown format {format!r}")


def file_md5(source: str | Iterable[str]) -> str:
    """The digest of a file or of lines."""
    if isinstance(source, str):
        return md5_of(source)
    digest = hashlib.md5()
    for line in source:
        digest.update(line.encode())
    return digest.hexdigest()


def files_md5(spark: SparkSession, path: str) -> DataFrame:
    """``(path, md5)`` of many files, in the cluster."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def text_to_json(spark: SparkSession, source: str | Iterable[str], generated_by: str = GENERATED_BY, **options: Any) -> str:
    """A wide text table as a JSON document; options are those of ``read_tsv``."""
    from sparrix.sources.json_table import to_json
    from sparrix.sources.tsv import read_tsv

    return to_json(read_tsv(spark, source, **options), generated_by)


def json_to_text(spark: SparkSession, source: str | dict[str, Any], **options: Any) -> str:
    """A JSON document as wide text; options are those of ``to_tsv``."""
    from sparrix.sources.json_table import read_json
    from sparrix.sources.tsv import to_tsv

    return to_tsv(read_json(spark, source), **options)

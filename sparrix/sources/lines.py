"""Lines of text files with their order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, source: str | Iterable[str]) -> DataFrame:
    """``(line_no, line)`` of a path or of given lines; numbers grow with the place, with gaps.

    A file is split among tasks; the number is made of its block's start and the place in
    the task.
    """
    if isinstance(source, str):
        df = spark.read.text(source).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
        return df.select(F.struct("f", "b", "m").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = [(("", 0, i), line.rstrip("\r\n")) for i, line in enumerate(source)]
    return spark.createDataFrame(rows, "line_no struct<f:string,b:long,m:long>, line string")

"""Long text formats: adjacency lists, cluster files, FASTA headers and mapping files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrix.core import MatrixTable, renumbered
from sparrix.errors import ParseError
from sparrix.sources.lines import read_lines

#: The header that an adjacency list may have.
ADJACENCY_HEADER = "#OTU ID\tSampleID\tvalue"


def read_adjacency(spark: SparkSession, source: str | Iterable[str]) -> MatrixTable:
    """``observation <tab> sample <tab> value`` lines; repeated cells are added, ids sorted."""
    lines = read_lines(spark, source).where((F.trim("line") != "") & (F.col("line") != ADJACENCY_HEADER))
    p = F.split("line", "\t")
    value = F.trim(F.get(p, F.lit(2))).try_cast("double")
    bad = (F.size(p) != 3) | value.isNull()
    rows = lines.select(
        F.get(p, F.lit(0)).alias("obs_id"), F.get(p, F.lit(1)).alias("samp_id"),
        F.when(bad, F.raise_error(F.concat(F.lit("not an adjacency line: "), F.col("line")))).otherwise(value).cast("double").alias("value"),
    )
    return MatrixTable.from_triples(rows)


def read_uc(spark: SparkSession, source: str | Iterable[str], names: DataFrame | None = None) -> MatrixTable:
    """A cluster file: counts of the H and S records; L records name an observation only.

    The sample is the query's text before its last underscore. ``names`` (id, new_id)
    renames observations. Ids come in the order of their first record.
    """
    f = F.split("line", "\t")
    word = lambda i: F.get(F.split(F.trim(F.get(f, F.lit(i))), r"\s+"), F.lit(0))
    rows = read_lines(spark, source).where((F.trim("line") != "") & ~F.col("line").startswith("#")).select("line_no", F.get(f, F.lit(0)).alias("t"), word(8).alias("q"), word(9).alias("o"))
    rows = rows.where(F.col("t").isin("H", "S", "L")).select("line_no", "t", "q", F.when(F.col("o") == "*", F.col("q")).otherwise(F.col("o")).alias("obs_id"))
    no_sample = F.raise_error(F.concat(F.lit("a query without an underscore names no sample: "), F.col("q")))
    sample = F.when(F.col("t") == "L", F.lit(None)).when(F.col("q").contains("_"), F.regexp_extract("q", "^(.*)_", 1)).otherwise(no_sample)
    rows = rows.select("line_no", "obs_id", sample.cast("string").alias("samp_id"))
    obs = renumbered(rows.groupBy(F.col("obs_id").alias("id")).agg(F.min("line_no").alias("n")), "n").select("id", "ord")
    samp = renumbered(rows.where("samp_id is not null").groupBy(F.col("samp_id").alias("id")).agg(F.min("line_no").alias("n")), "n").select("id", "ord")
    table = MatrixTable.from_triples(rows, value=F.lit(1.0), obs_axis=obs, samp_axis=samp)
    return table if names is None else table.update_ids(names, "observation", strict=True)


def read_fasta_names(spark: SparkSession, source: str | Iterable[str]) -> DataFrame:
    """``(id, new_id)`` from FASTA headers ``>name sequence``: the sequence's id and the name."""
    p = F.split(F.trim(F.substring("line", 2, 1 << 30)), r"\s+")
    rows = read_lines(spark, source).where(F.col("line").startswith(">")).select(F.get(p, F.lit(1)).alias("id"), F.get(p, F.lit(0)).alias("new_id"))
    return rows.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("a header without a sequence id: "), F.col("new_id")))).otherwise(F.col("id")))


def read_mapping(
    spark: SparkSession, source: str | Iterable[str], strip_quotes: bool = True, strip_spaces: bool = True, header: Sequence[str] | None = None,
    process: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``id`` and a column for each field of a mapping file.

    The first ``#`` line is the header unless one is given, other ``#`` lines are comments.
    Short rows are filled with empty text. Ids must be unique.
    """

    def clean(c: Column) -> Column:
        c = F.regexp_replace(c, '"', "") if strip_quotes else c
        return F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")) if strip_spaces else c

    lines = read_lines(spark, source).select("line_no", clean(F.col("line")).alias("line")).where(F.trim("line") != "")
    if header is None:
        first = lines.where(F.col("line").startswith("#")).orderBy("line_no").first()
        if first is None:
            raise ParseError("no header line in the mapping file")
        header = first["line"][1:].strip().split("\t")
    rows = lines.where(~F.col("line").startswith("#")).select(F.split("line", "\t").alias("p"))
    fields = [(process or {}).get(name, lambda c: c)(F.coalesce(clean(F.get("p", F.lit(i))), F.lit(""))).alias(name) for i, name in enumerate(header) if i]
    out = rows.select(clean(F.get("p", F.lit(0))).alias("id"), *fields)
    if out.isEmpty():
        raise ParseError("no data in the mapping file")
    if not out.groupBy("id").count().where("count > 1").isEmpty():
        raise ParseError("the ids of the mapping file are not unique")
    return out


def mapping_frame(spark: SparkSession, mapping: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """A mapping of ids to fields as the frame that ``read_mapping`` gives."""
    names = list(dict.fromkeys(k for fields in mapping.values() for k in fields))
    schema = T.StructType([T.StructField(k, T.StringType()) for k in ["id", *names]])
    return spark.createDataFrame([(i, *[fields.get(k, "") for k in names]) for i, fields in mapping.items()], schema)

"""Queries over the rest of the surface, each with its SQL: look-ups, files, commands, errors, streams.

Files are written to the shared folder and read back, so a query covers a sink and its source.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix import cli
from sparrix.config import parse_settings
from sparrix.core import MatrixTable, Props
from sparrix.errors import PROFILE, DisjointIDError, TableError, errstate, geterr, geterrcall, seterrcall
from sparrix.functions import scalar
from sparrix.plans.matrix import Query, _read, abundances, sales
from sparrix.plans.oracles import CELLS, SENT
from sparrix.runtime import work_path
from sparrix.sources import read_matrix, sniff, write_matrix
from sparrix.sources.files import copy_changed, text_file
from sparrix.sources.frames import to_pandas
from sparrix.sources.json_table import field, read_json, subset
from sparrix.sources.long import read_adjacency, read_fasta_names, read_mapping, read_uc
from sparrix.sources.parquet import read_parquet, write_parquet
from sparrix.sources.tsv import read_tsv

_ALL: dict[str, tuple[Query, str]] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    """Rows as SQL."""
    sql = lambda x: "NULL" if x is None else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) v({names})"


def clicks(spark: SparkSession, d: str) -> MatrixTable:
    """Users by types of event, with the number of events."""
    return MatrixTable.from_triples(_read(spark, d, "events"), F.col("user_id").cast("string"), "event_type", F.lit(1.0), props=Props("clicks", "OTU table"))


CLICKS = "WITH cells AS (SELECT CAST(user_id AS VARCHAR) AS obs_id, event_type AS samp_id, CAST(COUNT(*) AS DOUBLE) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2) "
ALL_CLICKS = CLICKS + "SELECT obs_id, samp_id, value FROM cells"


def places(spark: SparkSession, d: str) -> MatrixTable:
    """Regions by nations; a small table."""
    nation = _read(spark, d, "nation")
    region = _read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("ord"), F.struct(F.col("r_name").alias("name")).alias("md"))
    samp = nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.struct(F.col("n_name").alias("name")).alias("md"))
    return MatrixTable.from_triples(nation, "n_regionkey", "n_nationkey", F.col("n_nationkey") + 1.0, region, samp)


PLACES = "WITH cells AS (SELECT n_regionkey AS obs_id, n_nationkey AS samp_id, n_nationkey + 1.0 AS value FROM nation) "

# -- look-ups


@_query(
    CELLS + "SELECT fact, CAST(value AS DOUBLE) AS value FROM (SELECT 'observations' AS fact, COUNT(*) AS value FROM part UNION ALL SELECT 'samples', COUNT(*) FROM supplier "
    "UNION ALL SELECT 'nnz', COUNT(*) FROM cells UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'has 7', COUNT(*) FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 'has -7', 0 "
    "UNION ALL SELECT 'index of 7', COUNT(*) FROM supplier WHERE s_suppkey < 7) x"
)
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    rows, columns = t.shape
    facts = {"observations": rows, "samples": columns, "nnz": t.nnz, "empty": t.is_empty(), "has 7": t.exists(7), "has -7": t.exists(-7), "index of 7": t.index(7, "sample")}
    assert rows == t.length("observation") and t.dtype == "double" and t.matrix_data is t.cells
    return _rows(spark, [(k, float(v)) for k, v in facts.items()], "fact string, value double")


@_query(
    PLACES + "SELECT (SELECT COUNT(*) FROM region) || ' x ' || (SELECT COUNT(*) FROM nation) || ' MatrixTable with ' || (SELECT COUNT(*) FROM cells) || ' nonzero entries (' || "
    "CAST(FLOOR(100.0 * (SELECT COUNT(*) FROM cells) / ((SELECT COUNT(*) FROM region) * (SELECT COUNT(*) FROM nation))) AS BIGINT) || '% dense)' AS text"
)
def table_repr(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(repr(places(spark, d)),)], "text string")


@_query("SELECT s_suppkey AS id FROM supplier")
def ids_in_order(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).ids("sample")


@_query("SELECT p_partkey AS id, p_brand AS brand, p_size AS size FROM part")
def metadata_of_all(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).metadata(axis="observation").select("id", "md.brand", "md.size")


@_query("SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier WHERE s_suppkey = 7")
def metadata_of_one(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).metadata(7, "sample").select("id", "md.nation")


@_query(_values([("graph", "json", "{}"), ("tree", "newick", "(1,2);")], "category, kind, value"))
def group_metadata_kept(spark: SparkSession, d: str) -> DataFrame:
    t = places(spark, d).add_group_metadata({"tree": ("newick", "(1,2);")}, "observation").transpose().add_group_metadata({"graph": ("json", "{}")}).copy()
    return _rows(spark, [(k, *v) for k, v in t.group_metadata().items()], "category string, kind string, value string")


_AT = "(SELECT {0} FROM {1} ORDER BY {0} LIMIT 1 OFFSET {2})"
_SUPPLIER, _PART = _AT.format("s_suppkey", "supplier", 6), _AT.format("p_partkey", "part", 3)


@_query(
    CELLS + f"SELECT 'column' AS what, p_partkey AS id, COALESCE(value, 0.0) AS value FROM part LEFT JOIN cells ON obs_id = p_partkey AND samp_id = {_SUPPLIER} "
    f"UNION ALL SELECT 'row', s_suppkey, COALESCE(value, 0.0) FROM supplier LEFT JOIN cells ON samp_id = s_suppkey AND obs_id = {_PART} "
    f"UNION ALL SELECT 'cell', 0, COALESCE((SELECT value FROM cells WHERE obs_id = {_PART} AND samp_id = {_SUPPLIER}), 0.0) "
    "UNION ALL SELECT 'last', p_partkey, COALESCE(value, 0.0) FROM part LEFT JOIN cells ON obs_id = p_partkey AND samp_id = (SELECT MAX(s_suppkey) FROM supplier)"
)
def by_position(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    parts = [("column", t[:, 6]), ("row", t[3, :]), ("last", t[:, -1])]
    out = _rows(spark, [("cell", 0, t[3, 6])], "what string, id long, value double")
    for what, df in parts:
        out = out.unionByName(df.select(F.lit(what).alias("what"), "id", "value"))
    return out


@_query(CELLS + "SELECT s_suppkey AS id, (SELECT COUNT(*) FROM part) AS length, COALESCE(SUM(value), 0.0) AS total, COUNT(value) AS nonzeros FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY s_suppkey")
def vectors_dense(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).map_vectors(lambda v: (len(v), float(v.sum()), int(np.count_nonzero(v != 0))), "length int, total double, nonzeros int", "sample")


@_query(CELLS + "SELECT obs_id, samp_id, value FROM cells")
def vectors_sparse(spark: SparkSession, d: str) -> DataFrame:
    v = sales(spark, d).vectors("observation", dense=False).select(F.col("id").alias("obs_id"), F.explode("values").alias("x"))
    return v.select("obs_id", F.col("x.id").alias("samp_id"), "x.value")


@_query(
    "SELECT n.n_nationkey AS id, n_name AS name, LIST_AGGREGATE(LIST(CASE WHEN r_regionkey = n_regionkey THEN CAST(n_nationkey + 1 AS BIGINT) ELSE 0 END ORDER BY r_regionkey), 'string_agg', ' ') AS text "
    "FROM nation n, region GROUP BY 1, 2"
)
def iterated(spark: SparkSession, d: str) -> DataFrame:
    t = places(spark, d)
    rows = [(int(i), md["name"], " ".join(str(int(x)) for x in v)) for v, i, md in t.iter("sample")]
    assert [list(v) for v, _, _ in t] == [list(v) for v in t.iter_data("sample")]
    return _rows(spark, rows, "id int, name string, text string")


@_query(_values([("copy", ""), ("type", "type"), ("order", "sample ids"), ("metadata", "observation metadata"), ("cells", "cells"), ("ids", "observation ids")], "changed, difference"))
def compared(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    others = {
        "copy": t.copy(), "type": t._new(type="x"), "order": t._with_axis("sample", t.samp.withColumn("ord", -F.col("ord"))), "metadata": t.del_metadata(["brand"], "observation"),
        "cells": t.transform(F.col("value") + 1), "ids": t.filter(F.col("id") > 1, "observation"),
    }
    assert t == others["copy"] and t != others["cells"]
    return _rows(spark, [(k, t.differences(o)) for k, o in others.items()], "changed string, difference string")


# -- groups, aggregates, combinations


@_query(CELLS + "SELECT s_nationkey AS label, COUNT(DISTINCT s_suppkey) AS members, COALESCE(SUM(value), 0.0) AS total FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY 1")
def partition_tables(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for label, t in sales(spark, d).partition(F.col("md.nation"), "sample"):
        none = F.lit(0).cast("long").alias("members")
        part = t.sum().select(F.lit(label).alias("label"), none, "total").unionByName(t.samp.agg(F.lit(label).alias("label"), F.count("*").alias("members"), F.lit(0.0).alias("total")))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("label").agg(F.sum("members").alias("members"), F.sum("total").alias("total"))


@_query(CELLS + "SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS obs_id, samp_id, SUM(value) AS value FROM cells JOIN part ON p_partkey = obs_id GROUP BY 1, 2")
def collapse_by_callable(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse(lambda i, md: "large" if md["size"] > 25 else "small", "observation", norm=False).cells


@_query(CELLS + "SELECT 'low' AS samp_id, obs_id, SUM(value) AS value FROM cells WHERE samp_id IN (1, 2, 3) GROUP BY 2 UNION ALL SELECT 'high', obs_id, SUM(value) FROM cells WHERE samp_id IN (8, 9) GROUP BY 2")
def collapse_by_mapping(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse({"low": [1, 2, 3], "high": [8, 9]}, "sample", norm=False).cells


@_query(
    CELLS + ", b AS (SELECT p_partkey, UNNEST(string_split(p_name, ' ')) AS bin FROM part) SELECT bin AS obs_id, samp_id, SUM(value) AS value FROM cells JOIN b ON p_partkey = obs_id GROUP BY 1, 2"
)
def one_to_many_generator(spark: SparkSession, d: str) -> DataFrame:
    def bins(id_, md):
        for word in md["name"].split(" "):
            yield md["name"], word

    return sales(spark, d).collapse_one_to_many(bins, "observation").cells


@_query("SELECT s_suppkey AS id, ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1 AS pos, s_acctbal AS balance FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def aligned_to_frame(spark: SparkSession, d: str) -> DataFrame:
    rich = _read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    t, md = sales(spark, d).align_to_frame(rich)
    return t.positions("sample").join(md, "id")


@_query(_values([("9", 0), ("3", 1), ("14", 2)], "id, pos"))
def aligned_to_tree(spark: SparkSession, d: str) -> DataFrame:
    t = places(spark, d)
    named = t.update_ids(t.samp.select("id", F.col("id").cast("string").alias("new_id")), "sample")
    aligned, tips = named.align_tree("((9:0.1,'no such':2)n1:1,(3[note],14));", "sample")
    assert tips == ["9", "3", "14"]
    return aligned.positions("sample")


@_query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def pairwise_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).pairwise_ids("sample", tri=False)


@_query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <= b.n_nationkey")
def pairwise_with_self(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).pairwise_ids("sample", diag=True)


@_query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, CASE WHEN a.n_regionkey = b.n_regionkey THEN CAST((a.n_nationkey + 1) * (b.n_nationkey + 1) AS DOUBLE) ELSE 0.0 END AS dot FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def pairwise_vectors(spark: SparkSession, d: str) -> DataFrame:
    pairs = places(spark, d).iter_pairwise("sample")
    products = F.zip_with("values_i", "values_j", lambda a, b: a * b)
    return pairs.select("i", "j", F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("dot"))


@_query(_values([("DisjointIDError", "observation"), ("DisjointIDError", "sample"), ("TableError", "merge")], "error, place"))
def disjoint_ids_reported(spark: SparkSession, d: str) -> DataFrame:
    t, found = clicks(spark, d), []
    for axis in ("observation", "sample"):
        try:
            t.concat(t, axis)
        except DisjointIDError as e:
            found.append((type(e).__name__, axis))
    try:
        t.merge(t.update_ids(t.samp.select("id", F.concat(F.lit("x"), "id").alias("new_id")), "sample"), sample="intersection")
    except TableError as e:
        found.append((type(e).__name__, "merge"))
    return _rows(spark, found, "error string, place string")


@_query(CELLS + "SELECT obs_id, samp_id, value, ROW_NUMBER() OVER (PARTITION BY samp_id ORDER BY obs_id <= 1000, obs_id) AS nth FROM cells")
def concat_observations(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    joined = t.filter(F.col("id") > 1000, "observation").concat(t.filter(F.col("id") <= 1000, "observation"), "observation")
    placed = joined.cells.join(joined.obs.select(F.col("id").alias("obs_id"), "ord"), "obs_id")
    from pyspark.sql import Window

    return placed.select("obs_id", "samp_id", "value", F.row_number().over(Window.partitionBy("samp_id").orderBy("ord")).cast("long").alias("nth"))


@_query("SELECT p_partkey AS id, p_brand || '+' AS brand FROM part")
def merge_metadata_callable(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    other = t._with_axis("observation", t.obs.withColumn("md", F.col("md").withField("brand", F.concat("md.brand", F.lit("+")))))
    return t.merge(other, metadata=lambda a, b: F.coalesce(b, a)).obs.select("id", "md.brand")


@_query(
    CELLS + "SELECT 'least' AS what, s_suppkey AS id, MIN(value) AS value FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY 2 UNION ALL SELECT 'most', s_suppkey, MAX(value) FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY 2 "
    "UNION ALL SELECT 'all least', 0, MIN(value) FROM cells UNION ALL SELECT 'all most', 0, MAX(value) FROM cells"
)
def extremes(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    parts = [("least", t.min("sample")), ("most", t.max("sample")), ("all least", t.min("whole").select(F.lit(0).cast("long").alias("id"), "least")), ("all most", t.max("whole").select(F.lit(0).cast("long").alias("id"), "most"))]
    out = None
    for what, df in parts:
        part = df.toDF("id", "value").select(F.lit(what).alias("what"), "id", "value")
        out = part if out is None else out.unionByName(part)
    return out


@_query(CELLS + "SELECT p_partkey AS id, COALESCE(SUM(value), 0.0) AS n FROM part LEFT JOIN cells ON obs_id = p_partkey GROUP BY 1 UNION ALL SELECT -1, CAST(COUNT(*) AS DOUBLE) FROM cells UNION ALL SELECT -2, SUM(value) FROM cells")
def nonzero_sums(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    whole = [t.nonzero_counts("whole", binary).select(F.lit(-1 - i).cast("long").alias("id"), "n") for i, binary in enumerate((True, False))]
    return t.nonzero_counts("observation", binary=False).unionByName(whole[0]).unionByName(whole[1])


@_query(CELLS + "SELECT s_suppkey AS id, COALESCE(MAX(value), 0.0) AS value FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY s_suppkey")
def reduce_callable(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).reduce(lambda a, b: max(a, b), "sample")


_LINES = (
    CLICKS + ", t AS (SELECT samp_id, SUM(value) AS n FROM cells GROUP BY 1), s AS (SELECT COUNT(*) AS c, (SELECT COUNT(DISTINCT obs_id) FROM cells) AS o, SUM(n) AS total, MIN(n) AS mn, MAX(n) AS mx, MEDIAN(n) AS md, AVG(n) AS av, STDDEV_POP(n) AS sd FROM t) "
    "SELECT UNNEST(['Num samples: ' || FORMAT('{:,}', c), 'Num observations: ' || FORMAT('{:,}', o), 'Total count: ' || FORMAT('{:,}', CAST(total AS BIGINT)), 'Table density (fraction of non-zero values): ' || PRINTF('%.3f', (SELECT COUNT(*) FROM cells) / CAST(c * o AS DOUBLE)), "
    "'Counts/sample summary:', ' Min: ' || FORMAT('{:,.3f}', mn), ' Max: ' || FORMAT('{:,.3f}', mx), ' Median: ' || FORMAT('{:,.3f}', md), ' Mean: ' || FORMAT('{:,.3f}', av), ' Std. dev.: ' || FORMAT('{:,.3f}', sd), "
    "' Sample Metadata Categories: None provided', ' Observation Metadata Categories: None provided', 'Counts/sample detail:']) AS line FROM s UNION ALL SELECT samp_id || ': ' || FORMAT('{:,.3f}', n) FROM t"
)


@_query(_LINES)
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(x,) for x in clicks(spark, d).summary_text().split("\n") if x], "line string")


@_query(
    _values(
        [(q, a, n, t) for q, a, texts in (
            ("totals", "sample", ("Counts/sample summary:", "Counts/sample detail:")), ("totals", "observation", ("Counts/sample summary:", "Counts/sample detail:")),
            ("numbers", "sample", ("Observations/sample summary:", "Observations/sample detail:")), ("numbers", "observation", ("Sample/observations summary:", "Observations/sample detail:")),
        ) for n, t in enumerate(texts)], "kind, axis, nth, heading",
    )
)
def summary_headings(spark: SparkSession, d: str) -> DataFrame:
    t, found = places(spark, d), []
    for kind, qualitative in (("totals", False), ("numbers", True)):
        for axis in ("sample", "observation"):
            heads = [x for x in t.summary_text(qualitative, axis).split("\n") if x.endswith(":")]
            found += [(kind, axis, n, x) for n, x in enumerate(heads)]
    return _rows(spark, found, "kind string, axis string, nth int, heading string")


@_query(CELLS + "SELECT obs_id, samp_id, ROW_NUMBER() OVER (ORDER BY obs_id, samp_id) AS nth FROM cells")
def nonzero_order(spark: SparkSession, d: str) -> DataFrame:
    """The non-zero cells row by row, numbered as they come."""
    order = sales(spark, d).nonzero()
    placed = order.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))  # both grow with the place in a sorted frame
    from pyspark.sql import Window

    return placed.select("obs_id", "samp_id", F.row_number().over(Window.orderBy("p", "m")).cast("long").alias("nth"))


# -- samples: what must hold for any draw

ENOUGH = CELLS + ", t AS (SELECT samp_id, SUM(FLOOR(value)) AS n FROM cells GROUP BY 1) SELECT samp_id, CAST({n} AS DOUBLE) AS total FROM t WHERE n >= {least}"


@_query(ENOUGH.format(n="5000.0", least=5000))
def subsample_totals(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample(5000, seed=3).sum("sample").withColumnRenamed("id", "samp_id")


@_query(ENOUGH.format(n="5000.0", least=0))
def subsample_replaced_totals(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample(5000, with_replacement=True, seed=3).sum("sample").withColumnRenamed("id", "samp_id")


@_query(ENOUGH.format(n="1000.0", least=1000))
def subsample_by_hash_totals(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample_by_hash(1000, seed=3).sum("sample").withColumnRenamed("id", "samp_id")


@_query(CELLS + "SELECT obs_id, samp_id FROM cells WHERE FALSE")
def subsample_above_the_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells drawn more often than they count, without replacement: none."""
    t = sales(spark, d)
    drawn = t.subsample(5000, seed=3).cells.unionByName(t.subsample_by_hash(1000, seed=3).cells).withColumnRenamed("value", "drawn")
    return drawn.join(t.cells, ["obs_id", "samp_id"], "left").where("value is null or drawn > value or drawn <> floor(drawn)").select("obs_id", "samp_id")


@_query(CELLS + "SELECT seed, CAST(10 AS BIGINT) AS ids, CAST(0 AS BIGINT) AS changed FROM (VALUES (5), (6)) v(seed)")
def subsamples_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Number of ids drawn, and of cells of these that differ from the table's."""
    t, out = sales(spark, d), None
    for seed, s in zip((5, 6), t.subsamples(10, "sample", by_id=True, seed=5), strict=False):
        kept = t.cells.join(s.samp.select(F.col("id").alias("samp_id")), "samp_id", "left_semi").select("obs_id", "samp_id", F.col("value").alias("v"))
        changed = kept.join(s.cells, ["obs_id", "samp_id"], "full").where(~F.col("v").eqNullSafe(F.col("value"))).agg(F.count("*").alias("changed"))
        ids = s.samp.agg(F.lit(seed).alias("seed"), F.count("*").alias("ids"), F.lit(0).cast("long").alias("changed"))
        part = ids.unionByName(changed.select(F.lit(seed).alias("seed"), F.lit(0).cast("long").alias("ids"), "changed"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("seed").agg(F.sum("ids").alias("ids"), F.sum("changed").alias("changed"))


# -- files


def _saved(t: MatrixTable, kind: str, **options) -> str:
    path = f"{work_path(t.cells.sparkSession, 'saved')}.{kind}"
    write_matrix(t, path, kind, **options)
    return path


@_query(CELLS + "SELECT CAST(obs_id AS VARCHAR) AS obs_id, CAST(samp_id AS VARCHAR) AS samp_id, value FROM cells")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return read_matrix(spark, _saved(sales(spark, d), "json")).cells


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS ord, p_brand AS brand, p_size AS size FROM part")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    return read_json(spark, _saved(sales(spark, d), "json")).obs.select("id", "ord", "md.brand", F.col("md.size").cast("int").alias("size"))


@_query(CLICKS + "SELECT 'id' AS field, 'clicks' AS value UNION ALL SELECT 'type', 'OTU table' UNION ALL SELECT 'matrix_type', 'sparse' UNION ALL SELECT 'shape', COUNT(DISTINCT obs_id) || ' ' || COUNT(DISTINCT samp_id) FROM cells")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    path = _saved(clicks(spark, d), "json")
    found = {k: field(spark, path, k) for k in ("id", "type", "matrix_type", "shape")}
    return _rows(spark, [(k, v if isinstance(v, str) else " ".join(map(str, v))) for k, v in found.items()], "field string, value string")


@_query(ALL_CLICKS + " WHERE samp_id = (SELECT MIN(samp_id) FROM cells)")
def json_subset(spark: SparkSession, d: str) -> DataFrame:
    t = clicks(spark, d)
    return subset(read_json(spark, _saved(t, "json")), [t.ids("sample").first()["id"]], "sample").cells


@_query(ALL_CLICKS)
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return read_matrix(spark, _saved(clicks(spark, d), "tsv")).cells


@_query(CLICKS + "SELECT DISTINCT obs_id AS id, 'user; ' || obs_id AS lineage FROM cells")
def tsv_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = clicks(spark, d)
    t = t._with_axis("observation", t.obs.withColumn("md", F.struct(F.array(F.lit("user"), F.col("id")).alias("lineage"))))
    return read_tsv(spark, _saved(t, "tsv", header_key="lineage")).obs.select("id", "md.lineage")


@_query(CELLS + "SELECT CAST(obs_id AS VARCHAR) AS obs_id, CAST(samp_id AS VARCHAR) AS samp_id, value FROM cells")
def adjacency_read(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "adjacency")
    lines = _read(spark, d, "lineitem").select(F.concat_ws("\t", "l_partkey", "l_suppkey", "l_quantity").alias("value"))
    spark.createDataFrame([("#OTU ID\tSampleID\tvalue",)], "value string").unionByName(lines).write.text(path)
    return read_adjacency(spark, path).cells


@_query(CELLS + "SELECT obs_id, samp_id, value FROM cells")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return read_matrix(spark, _saved(sales(spark, d), "parquet")).cells


@_query(CELLS + "SELECT obs_id, samp_id, value FROM cells WHERE samp_id IN (2, 5)")
def parquet_ids(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "saved")
    write_parquet(sales(spark, d), path, by="observation", both=True)
    return read_parquet(spark, path, [2, 5]).cells


_UC = "SELECT 'p' || l_partkey AS obs_id, 's' || l_suppkey AS samp_id, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2"


def _uc(spark: SparkSession, d: str) -> str:
    """A file of clusters: lines as queries of suppliers, parts as seeds."""
    path = work_path(spark, "uc")
    text = F.format_string("H\t0\t100\t99.0\t+\t0\t0\t100M\ts%d_%d x\tp%d y", "l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey")
    _read(spark, d, "lineitem").select(text.alias("value")).unionByName(spark.createDataFrame([("# made here",), ("N\t*\t1\t*\t*\t*\t*\t*\tq_1\t*",)], "value string")).write.text(path)
    return path


@_query(_UC)
def uc_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_uc(spark, _uc(spark, d)).cells


@_query(_UC.replace("'p' ||", "'new' ||"))
def uc_renamed(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "fasta")
    heads = _read(spark, d, "part").select(F.explode(F.array(F.format_string(">new%d p%d", "p_partkey", "p_partkey"), F.lit("ACGT"))).alias("value"))
    heads.write.text(path)
    used = _read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("id")).distinct()
    return read_uc(spark, _uc(spark, d), read_fasta_names(spark, path).join(used, "id", "left_semi")).cells


@_query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def mapping_read(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "mapping")
    lines = _read(spark, d, "supplier").select(F.format_string('%d\t "%s" \t%d', "s_suppkey", "s_name", "s_nationkey").alias("value"))
    spark.createDataFrame([("#key\tname\tnation",), ("# a comment",)], "value string").coalesce(1).unionByName(lines).write.text(path)
    return read_mapping(spark, path, header=["key", "name", "nation"])


@_query(_values([("json", "json"), ("parquet", "parquet"), ("tsv", "tsv")], "written, found"))
def formats_found(spark: SparkSession, d: str) -> DataFrame:
    t = places(spark, d)
    return _rows(spark, [(k, sniff.sniff(_saved(t, k))) for k in ("json", "tsv", "parquet")], "written string, found string")


@_query("SELECT MD5(STRING_AGG(n_name || CHR(10), '' ORDER BY n_nationkey)) AS digest FROM nation")
def file_digest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_path(spark, 'text')}.txt"
    with text_file(path) as out:
        out.rows(_read(spark, d, "nation"), ["n_nationkey"], "n_name")
    assert sniff.file_md5(path) == sniff.files_md5(spark, path).first()["md5"]
    return _rows(spark, [(sniff.file_md5(path),)], "digest string")


@_query(ALL_CLICKS)
def pandas_round_trip(spark: SparkSession, d: str) -> DataFrame:
    pdf = to_pandas(clicks(spark, d), dense=True)
    rows = [(o, s, float(v)) for (o, s), v in pdf.stack().items() if v]
    return _rows(spark, rows, "obs_id string, samp_id string, value double")


@_query(PLACES + "SELECT how, obs_id, samp_id, CAST(value AS DOUBLE) AS value FROM cells, (VALUES ('array'), ('dict'), ('lists'), ('rows'), ('triples')) v(how)")
def built_from_data(spark: SparkSession, d: str) -> DataFrame:
    """The constructor's ways of giving data, on the fixed tables of nations and regions."""
    nation = _read(spark, d, "nation").orderBy("n_nationkey").collect()
    o, s = [r["r_regionkey"] for r in _read(spark, d, "region").orderBy("r_regionkey").collect()], [r["n_nationkey"] for r in nation]
    triples = [[r["n_regionkey"], r["n_nationkey"], r["n_nationkey"] + 1.0] for r in nation]
    dense = np.zeros((len(o), len(s)))
    for a, b, v in triples:
        dense[a, b] = v
    ways = {"array": dense, "dict": {(a, b): v for a, b, v in triples}, "lists": dense.tolist(), "rows": [{(0, b): v for a, b, v in triples if a == i} for i in range(len(o))], "triples": triples}
    out = None
    for how, data in ways.items():
        part = MatrixTable.from_data(spark, data, o, s, input_is_dense=how == "lists").cells.select(F.lit(how).alias("how"), "obs_id", "samp_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


# -- scalar functions


@_query("SELECT id, pos, TRIM(l[pos + 1]) AS part FROM (SELECT *, UNNEST(range(0, len(l))) AS pos FROM (SELECT DISTINCT id, string_split(taxonomy, ';') AS l FROM obs WHERE taxonomy IS NOT NULL) a) b")
def split_on_semicolons(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "obs").select("id", "taxonomy").distinct().select("id", F.posexplode(scalar.split_list(F.col("taxonomy"))).alias("pos", "part"))


@_query(
    "SELECT id, p, q, TRIM(m[q + 1]) AS part FROM (SELECT *, UNNEST(range(0, len(m))) AS q FROM (SELECT id, p, string_split(l[p + 1], ';') AS m FROM (SELECT *, UNNEST(range(0, len(l))) AS p "
    "FROM (SELECT DISTINCT id, string_split(taxonomy, '|') AS l FROM obs WHERE taxonomy IS NOT NULL) a) b) c) e"
)
def split_on_semicolons_and_pipes(spark: SparkSession, d: str) -> DataFrame:
    lists = _read(spark, d, "obs").select("id", "taxonomy").distinct().select("id", F.posexplode(scalar.split_nested(F.col("taxonomy"))).alias("p", "l"))
    return lists.select("id", "p", F.posexplode("l").alias("q", "part"))


@_query("SELECT DISTINCT id, CASE WHEN REGEXP_MATCHES(TRIM(dob), '^[0-9]+$') THEN CAST(CAST(TRIM(dob) AS BIGINT) AS VARCHAR) ELSE dob END AS as_int, CAST(REGEXP_MATCHES(TRIM(dob), '^[0-9]+(\\.[0-9]+)?$') AS INTEGER) AS is_number FROM samp WHERE dob IS NOT NULL")
def numbers_read(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "samp").where("dob is not null").select("id", scalar.int_or_text(F.col("dob")).alias("as_int"), scalar.is_number(F.col("dob")).cast("int").alias("is_number")).distinct()


@_query("SELECT DISTINCT id, REGEXP_REPLACE(taxonomy, '^[\\[\\] \\n\\t]+|[\\[\\] \\n\\t]+$', '', 'g') AS text FROM obs")
def brackets_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "obs").select("id", scalar.strip_brackets(F.col("taxonomy")).alias("text")).distinct()


@_query("SELECT DISTINCT id, LIST_AGGREGATE(LIST_TRANSFORM(string_split(taxonomy, ';'), lambda x: REPLACE(TRIM(x), '|', ':')), 'string_agg', '; ') AS text FROM obs WHERE taxonomy IS NOT NULL")
def joined_again(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "obs").where("taxonomy is not null")
    return rows.select("id", scalar.join_nested(F.array(scalar.split_list(F.col("taxonomy")))).alias("text")).distinct()


@_query("SELECT n_regionkey AS region, LIST_AGGREGATE(LIST(n_nationkey ORDER BY n_nationkey), 'string_agg', ' ') AS nations, LIST_AGGREGATE(LIST(n_name ORDER BY n_nationkey), 'string_agg', ' ') AS names FROM nation GROUP BY 1")
def unzipped_and_flattened(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("first"), F.col("n_name").alias("second"))))
    lists = _read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(pairs.alias("p")).withColumn("u", scalar.unzipped(F.col("p")))
    return lists.select("region", F.array_join(scalar.flattened(F.array(F.col("u.first"))).cast("array<string>"), " ").alias("nations"), F.array_join("u.second", " ").alias("names"))


# -- errors


@_query(_values([(k, "ignore" if k == "empty" else "raise") for k in ("empty", "obsdup", "obsmdsize", "obsnull", "obssize", "sampdup", "sampmdsize", "sampnull", "sampsize")], "name, state"))
def error_states(spark: SparkSession, d: str) -> DataFrame:
    with errstate(all="warn"):
        assert set(geterr().values()) == {"warn"}
    return _rows(spark, list(geterr().items()), "name string, state string")


@_query(
    "WITH c AS (SELECT DISTINCT obs_id, samp_id FROM cells WHERE value IS NOT NULL AND value <> 0 AND obs_id IS NOT NULL AND samp_id IS NOT NULL) SELECT name, CAST(broken AS INTEGER) AS broken FROM ("
    "SELECT 'empty' AS name, (SELECT COUNT(*) FROM obs) = 0 OR (SELECT COUNT(*) FROM samp) = 0 AS broken "
    "UNION ALL SELECT 'obsdup', (SELECT COUNT(*) FROM (SELECT id FROM obs GROUP BY id HAVING COUNT(*) > 1)) > 0 UNION ALL SELECT 'sampdup', (SELECT COUNT(*) FROM (SELECT id FROM samp GROUP BY id HAVING COUNT(*) > 1)) > 0 "
    "UNION ALL SELECT 'obsnull', (SELECT COUNT(*) FROM obs WHERE id IS NULL) > 0 UNION ALL SELECT 'sampnull', (SELECT COUNT(*) FROM samp WHERE id IS NULL) > 0 "
    "UNION ALL SELECT 'obssize', (SELECT COUNT(*) FROM c WHERE obs_id NOT IN (SELECT id FROM obs WHERE id IS NOT NULL)) > 0 UNION ALL SELECT 'sampsize', (SELECT COUNT(*) FROM c WHERE samp_id NOT IN (SELECT id FROM samp WHERE id IS NOT NULL)) > 0) x"
)
def broken_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which checks the raw axes break, whose rows are sent again."""
    t = MatrixTable.from_triples(_read(spark, d, "cells"), obs_axis=_read(spark, d, "obs"), samp_axis=_read(spark, d, "samp"))
    return _rows(spark, [(k, int(PROFILE._checks[k]["test"](t))) for k in PROFILE.state if not k.endswith("mdsize")], "name string, broken int")


@_query(_values([("call", "seen"), ("print", "duplicate sample ids"), ("raise", "TableError"), ("warn", "duplicate sample ids")], "state, result"))
def error_handling(spark: SparkSession, d: str) -> DataFrame:
    import warnings

    t, found, seen = places(spark, d), [], []
    t = t._with_axis("sample", t.samp.unionByName(t.samp))
    before = geterrcall("sampdup")
    seterrcall("sampdup", lambda item: seen.append("seen"))
    try:
        with errstate(sampdup="call"):
            t.validate("sampdup")
    finally:
        seterrcall("sampdup", before)
    found.append(("call", seen[0]))
    with errstate(sampdup="print"), contextlib.redirect_stdout(io.StringIO()) as out:
        t.validate("sampdup")
    found.append(("print", out.getvalue().strip()))
    with errstate(sampdup="warn"), warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        t.validate("sampdup")
    found.append(("warn", str(caught[-1].message)))
    try:
        t.validate("sampdup")
    except TableError as e:
        found.append(("raise", type(e).__name__))
    return _rows(spark, found, "state string, result string")


@_query("SELECT 'nation_' || n_nationkey AS name, n_name AS value FROM nation")
def settings_read(spark: SparkSession, d: str) -> DataFrame:
    text = "# nations\n\n" + "".join(f"nation_{r['n_nationkey']}  \t{r['n_name']} \n" for r in _read(spark, d, "nation").collect())
    return _rows(spark, list(parse_settings(text).items()), "name string, value string")


# -- commands


def _printed(f: Callable, *args, **options) -> list[str]:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        f(*args, **options)
    return [x for x in out.getvalue().split("\n") if x]


@_query(CLICKS + "SELECT DISTINCT samp_id AS id FROM cells UNION SELECT obs_id FROM cells")
def cli_table_ids(spark: SparkSession, d: str) -> DataFrame:
    path = _saved(clicks(spark, d), "json")
    return _rows(spark, [(x,) for o in (False, True) for x in _printed(cli.table_ids, spark, path, o)], "id string")


@_query(_LINES)
def cli_summary(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_path(spark, 'summary')}.txt"
    cli.summarize_table(spark, _saved(clicks(spark, d), "json"), path)
    return spark.read.text(path).where("value <> ''").toDF("line")


@_query(
    PLACES + "SELECT CAST(r_regionkey AS VARCHAR) || STRING_AGG(CHR(9) || CASE WHEN n_regionkey = r_regionkey THEN n_nationkey + 1 ELSE 0 END || '.0', '' ORDER BY n_nationkey) AS line "
    "FROM region, nation WHERE r_regionkey < 2 AND n_nationkey < 3 GROUP BY r_regionkey UNION ALL SELECT '#OTU ID' || CHR(9) || '0' || CHR(9) || '1' || CHR(9) || '2' UNION ALL SELECT '# Constructed from a sparse table'"
)
def cli_head(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(x,) for x in _printed(cli.head, spark, _saved(places(spark, d), "json"), n_obs=2, n_samp=3)], "line string")


@_query(ALL_CLICKS)
def cli_convert(spark: SparkSession, d: str) -> DataFrame:
    """Text to JSON to the native layout."""
    a, b = f"{work_path(spark, 'a')}.json", work_path(spark, "b")
    cli.convert(spark, _saved(clicks(spark, d), "tsv"), a, to_json=True, table_type="Taxon table")
    cli.convert(spark, a, b, to_parquet=True)
    return read_matrix(spark, b).cells


@_query(ALL_CLICKS + " WHERE samp_id = (SELECT MAX(samp_id) FROM cells)")
def cli_subset(spark: SparkSession, d: str) -> DataFrame:
    t, ids, out = clicks(spark, d), f"{work_path(spark, 'ids')}.txt", f"{work_path(spark, 'part')}.json"
    with text_file(ids) as f:
        f.text("# ids\n" + t.samp.agg(F.max("id")).first()[0] + "\tmore\n")
    cli.subset_table(spark, "sample", ids, out, input_json_fp=_saved(t, "json"))
    return read_matrix(spark, out).cells


@_query(CLICKS + "SELECT obs_id, samp_id, ROUND(value / SUM(value) OVER (PARTITION BY samp_id), 6) AS value FROM cells")
def cli_normalize(spark: SparkSession, d: str) -> DataFrame:
    out = work_path(spark, "normal")
    cli.normalize_table(spark, _saved(clicks(spark, d), "json"), out, relative_abund=True)
    return read_matrix(spark, out).cells.select("obs_id", "samp_id", F.round("value", 6).alias("value"))


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, [n_name, 'x'] AS parts FROM nation".replace("[n_name, 'x']", "n_name || '|x'"))
def cli_add_metadata(spark: SparkSession, d: str) -> DataFrame:
    path, out = work_path(spark, "mapping"), work_path(spark, "more")
    nation = _read(spark, d, "nation")
    nation.select(F.format_string("%d\t%s\t%d\t%s;x", "n_nationkey", "n_name", "n_regionkey", "n_name").alias("value")).write.text(path)
    t = places(spark, d).del_metadata(axis="sample")
    cli.add_metadata(spark, _saved(t, "json"), out, sample_metadata_fp=path, sample_header="key,name,region,parts", int_fields="region", sc_separated="parts")
    return read_matrix(spark, out).samp.select("id", "md.name", F.col("md.region").cast("string").alias("region"), F.array_join("md.parts", "|").alias("parts"))


@_query("SELECT CAST(n_nationkey AS VARCHAR) || CHR(9) || n_name AS line FROM nation UNION ALL SELECT CHR(9) || 'name'")
def cli_export_metadata(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_path(spark, 'md')}.txt"
    cli.export_metadata(spark, _saved(places(spark, d), "json"), sample_metadata_fp=path)
    return spark.read.text(path).toDF("line")


@_query(_values([("bad", "The input file is not a valid table."), ("bad", "rows: missing"), ("good", "The input file is a valid table.")], "file, line"))
def cli_validate(spark: SparkSession, d: str) -> DataFrame:
    """A written document, and one without its rows."""
    good, bad = _saved(clicks(spark, d), "json"), f"{work_path(spark, 'bad')}.json"
    copy_changed(good, bad, '"rows":', '"lines":')
    return _rows(spark, [(name, x) for name, path in (("good", good), ("bad", bad)) for x in _printed(cli.validate_table, spark, path)], "file string, line string")


@_query(_UC)
def cli_from_uc(spark: SparkSession, d: str) -> DataFrame:
    out = work_path(spark, "clusters")
    cli.from_uc(spark, _uc(spark, d), out)
    return read_matrix(spark, out).cells


@_query(_values([("pyspark", 1), ("numpy", 1)], "name, there"))
def cli_install_info(spark: SparkSession, d: str) -> DataFrame:
    lines = _printed(cli.show_install_info)
    return _rows(spark, [(n, sum(x.strip().startswith(f"{n}:") for x in lines)) for n in ("pyspark", "numpy")], "name string, there int")


# -- streams


def _streamed(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream, of one file."""
    folder = work_path(spark, "stream")
    _read(spark, d, table).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(_read(spark, d, table).schema).parquet(folder)


@_query(SENT.replace("SELECT DISTINCT", "SELECT") + "SELECT obs_id, samp_id, ROUND(SUM(value), 6) AS value FROM once WHERE obs_id IS NOT NULL AND samp_id IS NOT NULL GROUP BY obs_id, samp_id HAVING SUM(value) <> 0")
def streamed_cells(spark: SparkSession, d: str) -> DataFrame:
    from sparrix.streaming.ingest import append_batches, appended_cells

    out = work_path(spark, "batches")
    append_batches(_streamed(spark, d, "cells"), out, work_path(spark, "offsets")).awaitTermination()
    return appended_cells(spark, out).select("obs_id", "samp_id", F.round("value", 6).alias("value"))


@_query("SELECT STRFTIME(DATE_TRUNC('day', ts), '%Y-%m-%d') AS start, event_type AS samp_id, COUNT(value) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY DATE_TRUNC('day', ts), 1, 2 HAVING DATE_TRUNC('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 7 DAY")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows that the watermark has closed."""
    from sparrix.streaming.ingest import windowed_totals

    out = work_path(spark, "windows")
    totals = windowed_totals(_streamed(spark, d, "events"), "ts", samp="event_type")
    totals.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "samp_id", "n", F.round("total", 4).alias("total"))


@_query(SENT + "SELECT obs_id, samp_id, ROUND(SUM(value), 6) AS value FROM once GROUP BY obs_id, samp_id HAVING SUM(value) <> 0")
def cells_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """The table cells by way of a transposed, renamed and reordered table."""
    t = abundances(spark, d).transpose().sort().transpose().sort(axis="sample")
    return t.cells.select("obs_id", "samp_id", F.round("value", 6).alias("value"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}

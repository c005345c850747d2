"""Registered queries of the matrix operators.

The main matrix has parts as observations, suppliers as samples and the quantity sold as
value; further ones come from the tables cells, samp and obs, and from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix.core import MatrixTable, Props
from sparrix.functions.scalar import natural_key
from sparrix.runtime import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{table}.parquet")


def sales(spark: SparkSession, d: str, lines: str = "true") -> MatrixTable:
    """Parts by suppliers; with a condition, of these lines only, for operators on several tables."""
    lines = _read(spark, d, "lineitem").where(lines)
    md = F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    part = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), md.alias("md"))
    supplier = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.struct(F.col("s_nationkey").alias("nation")).alias("md"))
    return MatrixTable.from_triples(lines, "l_partkey", "l_suppkey", "l_quantity", part, supplier, Props(type="OTU table"))


def abundances(spark: SparkSession, d: str) -> MatrixTable:
    """The table cells, each cell once, with its axes."""
    cells = _read(spark, d, "cells").select("cell_id", "obs_id", "samp_id", "value").distinct()
    axes = [_read(spark, d, t).groupBy("id").agg(F.min("ord").alias("ord")) for t in ("obs", "samp")]
    return MatrixTable.from_triples(cells, obs_axis=axes[0], samp_axis=axes[1])


@_query
def cells_from_triples(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).cells


@_query
def cells_from_events(spark: SparkSession, d: str) -> DataFrame:
    events = _read(spark, d, "events")
    return MatrixTable.from_triples(events, "user_id", "event_type", F.lit(1.0)).cells


@_query
def cells_sent_once(spark: SparkSession, d: str) -> DataFrame:
    return abundances(spark, d).cells.select("obs_id", "samp_id", F.round("value", 6).alias("value"))


@_query
def sum_sample(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).sum("sample").withColumnRenamed("id", "samp_id")


@_query
def sum_observation(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).sum("observation").withColumnRenamed("id", "obs_id")


@_query
def sum_whole(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).sum()


@_query
def sum_sample_with_empty(spark: SparkSession, d: str) -> DataFrame:
    return abundances(spark, d).sum("sample").select(F.col("id").alias("samp_id"), F.round("total", 6).alias("total"))


@_query
def min_max_nnz_sample(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    return t.vector_stats("sample").select(F.col("id").alias("samp_id"), F.col("least").alias("mn"), F.col("most").alias("mx"), "nnz")


@_query
def min_observation(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).min("observation")


@_query
def max_observation(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).max("observation")


@_query
def nonzero_counts_observation(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).nonzero_counts("observation")


@_query
def density(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(sales(spark, d).density(),)], "density double")


@_query
def norm_sample(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).norm("sample").cells


@_query
def norm_observation(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).norm("observation").cells


@_query
def norm_gathered(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).norm("sample", gather=True).cells


def _rank(method: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return sales(spark, d).rankdata("sample", method).cells

    _QUERIES[f"rankdata_{method}"] = query


for _method in ("average", "min", "max", "dense", "ordinal"):
    _rank(_method)


@_query
def presence_absence(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).pa().cells


@_query
def transform_mod3(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).transform(F.when(F.col("value") % 3 == 0, F.col("value")).otherwise(0.0)).cells


@_query
def transform_callable(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).transform(lambda values, id_, md: values * 2.0, "sample").cells


@_query
def filter_ids(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).filter([1, 3, 5, 7], "sample").cells


@_query
def filter_ids_invert(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).filter([1, 3, 5, 7], "sample", invert=True).cells


@_query
def filter_total_gt(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).filter(F.col("total") > 800, "observation").cells


@_query
def filter_metadata(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).filter(F.col("md.size") > 25, "observation").cells


@_query
def filter_callable(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).filter(lambda values, id_, md: (values == 0).sum() > 3 and md["nation"] < 12, "sample").samp.select("id")


@_query
def remove_empty(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d).transform(F.col("value") - 27)
    return t.remove_empty().cells


@_query
def head_5x5(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).head(5, 5).cells


@_query
def vector_dense(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).data(7, "sample").select("id", "value")


@_query
def value_by_ids(spark: SparkSession, d: str) -> DataFrame:
    keys = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("obs_id"), F.col("l_suppkey").alias("samp_id"))
    swapped = keys.select(F.col("obs_id"), (F.col("samp_id") + 1).alias("samp_id"))  # cells that are not there, ids that are unknown
    return sales(spark, d).values(keys.unionByName(swapped))


@_query
def nonzero(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).nonzero()


@_query
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).transpose().cells


@_query
def update_ids(spark: SparkSession, d: str) -> DataFrame:
    names = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("new_id"))
    return sales(spark, d).update_ids(names, "sample").cells


@_query
def metadata_added(spark: SparkSession, d: str) -> DataFrame:
    nation = _read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"))
    extra = _read(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("nation")).select(F.col("s_suppkey").alias("id"), "nation_name")
    return sales(spark, d).add_metadata(extra, "sample").samp.select("id", "md.nation", "md.nation_name")


@_query
def metadata_dropped(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).del_metadata(["name", "type"], "observation").metadata_columns("observation")


@_query
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    a, *others = (sales(spark, d, f"l_returnflag = '{flag}'") for flag in "ANR")
    return a.merge(others).cells


def _sold(spark: SparkSession, d: str) -> tuple[MatrixTable, MatrixTable]:
    """All lines in two tables, those returned and the others, each on the ids it holds."""
    return sales(spark, d, "l_returnflag = 'R'").remove_empty(), sales(spark, d, "l_returnflag <> 'R'").remove_empty()


@_query
def merge_intersection(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sold(spark, d)
    return a.merge(b, sample="intersection", observation="intersection").cells


@_query
def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sold(spark, d)
    return a.merge(b).obs.select("id", "ord", "md.brand")


@_query
def merge_sorted(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sold(spark, d)
    return a.merge(b, order="sorted").obs.select("id", "ord")


@_query
def concat_samples(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    joined = t.filter(F.col("id") > 40, "sample").concat(t.filter(F.col("id") <= 40, "sample"))
    return joined.cells.join(joined.samp.select(F.col("id").alias("samp_id"), "ord"), "samp_id")


@_query
def align_to(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d)
    other = t._with_axis("sample", t.samp.withColumn("ord", -F.col("ord")))
    return t.align_to(other, "sample").positions("sample")


@_query
def sort_order(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d).sort_order([9, 2, 5], "sample")
    return t.cells.join(t.samp.select(F.col("id").alias("samp_id"), "ord"), "samp_id")


@_query
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    names = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("x")).alias("new_id"))
    return sales(spark, d).update_ids(names, "sample").sort(natural_key, "sample").samp.select("id", "ord")


@_query
def collapse_sum(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse(F.col("md.brand"), "observation", norm=False).cells


@_query
def collapse_norm(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse(F.col("md.brand"), "observation").cells


@_query
def collapse_samples(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse(F.col("md.nation").cast("string"), "sample").cells


@_query
def collapse_min_group_size(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse(F.col("md.brand"), "observation", norm=False, min_group_size=80).cells


def _collapse(name: str, how, **options) -> None:
    _QUERIES[name] = lambda spark, d: sales(spark, d).collapse(F.col("md.type"), "observation", how=how, norm=False, **options).cells.select("obs_id", "samp_id", F.round("value", 6).alias("value"))


_collapse("collapse_median", "median")
_collapse("collapse_percentile", "percentile:0.99")
_collapse("collapse_max", "max")
_collapse("collapse_min", "min")
_collapse("collapse_mean", "mean")
_collapse("collapse_count", "count")
_collapse("collapse_callable", lambda values: float(values.max() - values.mean()))
_collapse("collapse_nonzero_median", F.median, nonzeros=True)


@_query
def collapse_one_to_many_add(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse_one_to_many(F.split("md.name", " "), "observation").cells


@_query
def collapse_one_to_many_divide(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d).collapse_one_to_many(F.split("md.name", " "), "observation", mode="divide")
    return t.cells.select("obs_id", "samp_id", F.round("value", 6).alias("value"))


@_query
def collapse_levels(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).collapse_levels(F.array("md.type", "md.brand"), "observation")


@_query
def collapsed_ids(spark: SparkSession, d: str) -> DataFrame:
    t = sales(spark, d).collapse(F.col("md.nation").cast("string"), "sample")
    return t.samp.select("id", F.array_join(F.col("md.collapsed_ids").cast("array<string>"), ",").alias("ids"))


@_query
def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("md.size") < 40, F.col("md.type"))
    return sales(spark, d).partition_sizes(label, "observation")


@_query
def pairwise_ids(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).pairwise_ids("sample")


@_query
def pairwise_dot(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).pairwise_dot("sample")


@_query
def reduce_fold(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).reduce(lambda a, b: F.greatest(a, b), "sample", column=True)


@_query
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).summary().select("mn", "mx", "med", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "total")


@_query
def summary_stats_binary(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d).summary("observation", binary=True)
    return s.select("mn", "mx", "med", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "total")


@_query
def positions(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).positions("observation")


@_query
def subsample_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample(5000, seed=3).cells


@_query
def subsample_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample(5000, with_replacement=True, seed=3).cells


@_query
def subsample_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample_by_hash(1000, seed=3).cells


@_query
def subsample_by_id(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).subsample(10, "sample", by_id=True, seed=3).cells


@_query
def table_files_validated(spark: SparkSession, d: str) -> DataFrame:
    from sparrix.spec import validate_documents

    return validate_documents(_read(spark, d, "table_files"), "file_id", "body").distinct()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Relative abundance of each supplier's parts, collapsed by brand."""
    return sales(spark, d).norm("sample").collapse(F.col("md.brand"), "observation").cells

"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix.llm.canon import canonical_text, look_alike_pairs, look_classes
from sparrix.llm.cluster import CompositionClusters
from sparrix.llm.cooccur import cooccurrence
from sparrix.llm.mix import SourceMix
from sparrix.llm.pack import pack_all
from sparrix.llm.stable import StableSample, lost_keys
from sparrix.llm.tokens import token_counts
from sparrix.runtime import materialize, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CompositionClusters(_read(spark, sf_dir, "cells")).group_pairs().select(F.col("a").alias("samp_a"), F.col("b").alias("samp_b"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CompositionClusters(_read(spark, sf_dir, "cells")).clusters()


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CompositionClusters(_read(spark, sf_dir, "cells")).members().withColumnRenamed("record", "samp_id")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the clusters: each record is in one and alike to its pivot, and a pivot is in its own."""
    members = materialize(p1_members(spark, sf_dir), "members")
    pivots = members.where("samp_id = pivot").select("pivot", F.lit(1).alias("there"))
    return members.join(pivots, "pivot", "left").agg(
        F.count("*").alias("members"), F.count_distinct("samp_id").alias("records"), F.count(F.when(~(F.col("similarity") >= 0.55 - 1e-6), 1)).alias("unlike"),
        F.count(F.when(F.col("there").isNull(), 1)).alias("without_pivot"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(_read(spark, sf_dir, "cells")).select(F.col("item_a").alias("obs_a"), F.col("item_b").alias("obs_b"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(_read(spark, sf_dir, "cells"), min_count=12, min_lift=2.0).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr")
    )


def p5_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that is together in any sample; p5_pairs gives those of its two bounds."""
    return cooccurrence(_read(spark, sf_dir, "cells"), min_count=1, min_lift=0.0, min_llr=0.0).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr")
    )


#: Deliveries of the two axes.
LOADS = [1, 2, 3, 4, 5]
#: Rates of the strata that have one of their own, by name; None stands for the null stratum.
SITE_RATES = {"gut": 0.05, "silt": 0.2}
RANK_RATES = {"unassigned": 0.05, "unclassified": 0.05, None: 0.05}
#: The name of the first rank of a lineage, behind wrappings, a root and a rank prefix.
FIRST_RANK = "^[^A-Za-z]*(?:[Rr]oot[^A-Za-z]+)?(?:[A-Za-z]_[_0-9]*)?([A-Za-z]*)"


def _samp_sample(samp: DataFrame) -> StableSample:
    """Samples by body site."""
    return StableSample(samp, "id", F.lower(F.trim(F.regexp_replace("body_site", "^[A-Za-z]+:", ""))), "load_no", 0.1, SITE_RATES)


def _obs_sample(obs: DataFrame) -> StableSample:
    """Observations by the first rank of their lineage."""
    return StableSample(obs, "id", F.lower(F.regexp_extract("taxonomy", FIRST_RANK, 1)), "load_no", 0.1, RANK_RATES)


AXES = {"samp": _samp_sample, "obs": _obs_sample}


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(_read(spark, sf_dir, axis)).sample().select(F.lit(axis).alias("axis"), F.col("key").alias("id"), F.col("delivery").alias("load_no")) for axis, f in AXES.items()]
    return parts[0].unionByName(parts[1])


def p6_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(_read(spark, sf_dir, axis)).thresholds().select(F.lit(axis).alias("axis"), "stratum", F.round("threshold", 9).alias("threshold"), "keys", "chosen") for axis, f in AXES.items()]
    return parts[0].unionByName(parts[1])


def p6_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids chosen from the deliveries up to one and not from those up to the next: there are none."""
    parts = [lost_keys(_read(spark, sf_dir, axis), LOADS, "load_no", f).select(F.lit(axis).alias("axis"), F.col("key").alias("id"), F.col("delivery").alias("load_no")) for axis, f in AXES.items()]
    return parts[0].unionByName(parts[1])


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_all(token_counts(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "containers"))
    return packed.withColumnRenamed("doc", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each kind, with the least number there could be."""
    packed = pack_all(token_counts(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "containers"))
    sums = packed.groupBy("container_kind").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    joined = sums.join(_read(spark, sf_dir, "containers"), "container_kind")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    unused = F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return joined.select("container_kind", "capacity_tokens", "containers", "tokens", least.alias("least_containers"), unused.alias("unused_share"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind: texts packed, and what must not be: containers too full, tokens lost or doubled, texts split that fit."""
    counts = materialize(token_counts(_read(spark, sf_dir, "documents")), "counts")
    containers = _read(spark, sf_dir, "containers")
    packed = materialize(pack_all(counts, containers), "packed").join(containers, "container_kind")
    full = packed.groupBy("container_kind", "container", "capacity_tokens").agg(F.sum("tokens").alias("n")).groupBy("container_kind").agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("too_full"))
    texts = packed.groupBy("container_kind", "doc", "capacity_tokens").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("numbers"))
    sizes = counts.groupBy("doc").agg(F.max("tokens").alias("tokens"))
    texts = texts.join(sizes, "doc", "full").groupBy("container_kind").agg(
        F.count("*").alias("texts"), F.count(F.when(~F.col("n").eqNullSafe(F.col("tokens")) | (F.col("pieces") != F.col("numbers")), 1)).alias("miscounted"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens")), 1)).alias("split_needlessly"),
    )
    return texts.join(full, "container_kind")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each listed source: places used too often, and whether its share is off by over a point from what its cap allows."""
    mix = _mix(spark, sf_dir)
    slots = materialize(mix.slots(), "slots")
    total = max(1, sum(mix.quota.values()))
    twice = slots.groupBy("source", "repeat_no", "block").count().groupBy("source").agg(F.count(F.when(F.col("count") > 1, 1)).alias("twice"), F.max("repeat_no").alias("last"), F.sum("count").alias("n"))
    planned = spark.createDataFrame([(s, mix.caps[s], mix.quota[s] / total) for s in mix.quota], "source string, cap int, planned double")
    joined = planned.join(twice, "source", "left").na.fill(0, ["twice", "n"])
    return joined.select(
        "source", F.col("twice").alias("placed_twice"), F.coalesce((F.col("last") >= F.col("cap")).cast("int"), F.lit(0)).alias("above_cap"), (F.abs(F.col("n") / total - F.col("planned")) > 0.01).cast("int").alias("share_off"),
    )


def _mix(spark: SparkSession, sf_dir: str) -> SourceMix:
    docs = _read(spark, sf_dir, "documents")
    targets = _read(spark, sf_dir, "mix_targets")
    return SourceMix(token_counts(docs, keep=("source",)), targets)


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).mixed().withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares_reached()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(_read(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_classes(_read(spark, sf_dir, "documents"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", canonical_text(F.col("text")).alias("text")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p1_members, p1_checks, p5_found, p5_pairs, p5_all_pairs, p6_sample, p6_thresholds, p6_lost, p7_packed, p7_fill, p7_checks, p8_mixed, p8_shares, p8_checks, p9_found, p9_classes, p9_canonical)}

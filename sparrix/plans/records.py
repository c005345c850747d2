"""Registered queries of the operators on raw records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparrix.operators.drift import header_fields, schema_changes, unify
from sparrix.operators.nested import TABLE_SHAPE, TABLES, node_table, relation_table, table_relations, unread_records
from sparrix.operators.packed import split_packed
from sparrix.runtime import materialize, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_relations(_read(spark, sf_dir, "table_files"))


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(_read(spark, sf_dir, "table_files"), ["file_id"], "body", TABLE_SHAPE).distinct()


def p2_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that give no rows, with the reason."""
    return unread_records(_read(spark, sf_dir, "table_files"), ["file_id"], "body").distinct()


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: relation_table(_read(spark, sf_dir, "table_files"), name)


#: The first columns of the common table, whatever a producer calls them; other meanings follow.
HEADER_COLUMNS = ["format", "matrix_type", "matrix_element_type", "type", "shape", "date", "generated_by"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(materialize(header_fields(_read(spark, sf_dir, "table_headers")), "fields"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = materialize(header_fields(_read(spark, sf_dir, "table_headers")), "fields")
    return unify(fields, schema_changes(fields), HEADER_COLUMNS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_packed(_read(spark, sf_dir, "obs"), "taxonomy", ["id"])
    return rows.toDF("obs_id", "pos", "taxon").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (p2_found, p2_nodes, p2_unread, p3_found, p3_unified, p4_found)}
    return named | {f"p2_{name}": _table(name) for name in TABLES}

"""Keyed sinks over immutable tables: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the incoming keys are replaced as a unit; columns that one
    side lacks are null."""
    kept = current.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def keep_only(current: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return current.join(keep.select(key).distinct(), key, "left_semi")


def retag(current: DataFrame, tags: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """New tags where the sorted lists differ; null lists count as the default."""
    old = F.coalesce(F.col(column), F.array(F.lit(default)))
    joined = current.join(tags.select(key, F.col(column).alias("_new")), key, "left")
    changed = F.col("_new").isNotNull() & (F.sort_array(old) != F.sort_array("_new"))
    return joined.withColumn("changed", changed).withColumn(column, F.when(changed, F.col("_new")).otherwise(F.col(column))).drop("_new")

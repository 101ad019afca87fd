"""Orphan references: records that point at records which do not exist.

References and parent keys are co-partitioned and sorted on (target, key) and
merged linearly (Spark's sort-merge join). Parents are first folded to one
validity interval per key, so each reference meets at most one parent row:

* ``missing`` - no parent row has the key
* ``deleted`` - every parent row with the key is deleted
* ``late``    - the earliest creation is after the reference's own time

Hot keys (a dst that a third of all edges name) would all land in one task of
a merge. A key is hot when it holds more than ``1/HOT_SHARE`` of all
references; there are fewer than HOT_SHARE such keys whatever the data size,
so their parent intervals (at most HOT_SHARE rows) are broadcast and those
references never shuffle. Everything else goes through the merge.

Defined results: null or blank keys are no reference; a null reference time
gives period ``unknown`` and can be missing or deleted but not late; a null
creation means the parent always existed; redelivered rows count once; empty
inputs give an empty result; extra columns of the inputs are ignored because
every input is projected to named columns first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share (1/HOT_SHARE) of all references on.
HOT_SHARE = 256

#: ASCII and Unicode white space stripped from both ends of an id.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)


def id_key(c: Column) -> Column:
    """Comparable form of an id: outer white space and case do not count;
    null when nothing is left."""
    key = F.lower(F.btrim(c.cast("string"), F.lit(BLANKS)))
    return F.when(key != "", key)


def reference_rows(
    df: DataFrame, src_table: str, key_col: str, time_col: str, fields: dict[str, str]
) -> DataFrame:
    """Unpivot the reference columns of one table in a single scan.

    ``fields`` maps a referring column to the name of its target."""
    entries = F.array(
        *[
            F.struct(
                F.lit(field).alias("src_field"),
                F.lit(target).alias("target"),
                id_key(F.col(field)).alias("key"),
            )
            for field, target in fields.items()
        ]
    )
    return (
        df.select(
            F.lit(src_table).alias("src_table"),
            F.col(key_col).cast("string").alias("row_key"),
            F.col(time_col).alias("ref_at"),
            F.explode(entries).alias("e"),
        )
        .select("src_table", "e.src_field", "row_key", "ref_at", "e.target", "e.key")
        .where(F.col("key").isNotNull())
    )


def parent_intervals(
    df: DataFrame, target: str, id_col: str, created_col: str, deleted_col: str
) -> DataFrame:
    """One validity interval per parent key: earliest creation (null = always
    existed) and whether any row is live."""
    return (
        df.select(
            id_key(F.col(id_col)).alias("key"),
            F.col(created_col).alias("created"),
            F.col(deleted_col).isNull().alias("is_live"),
        )
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.bool_or("is_live").alias("live"),
            F.bool_or(F.col("created").isNull()).alias("always"),
            F.min("created").alias("first_created"),
        )
        .select(
            F.lit(target).alias("target"),
            "key",
            "live",
            F.when(~F.col("always"), F.col("first_created")).alias("valid_from"),
        )
    )


def _fault() -> Column:
    return (
        F.when(F.col("live").isNull(), F.lit("missing"))
        .when(~F.col("live"), F.lit("deleted"))
        .when(F.col("valid_from") > F.col("ref_at"), F.lit("late"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Faulty references: src_table, src_field, row_key, period, fault."""
    out = ["src_table", "src_field", "row_key", "ref_at", "fault"]
    counts = refs.groupBy("target", "key").agg(F.count(F.lit(1)).alias("n_refs"))
    total = refs.agg(F.count(F.lit(1)).alias("n_all"))
    hot_keys = (
        counts.where(F.col("n_refs") * HOT_SHARE > total.scalar())
        .select("target", "key")
    )
    hot = F.broadcast(
        hot_keys.join(parents.hint("merge"), ["target", "key"], "left")
        .withColumn("hot", F.lit(True))
    )
    tagged = refs.join(hot, ["target", "key"], "left")
    heavy = tagged.where(F.col("hot")).withColumn("fault", _fault()).select(*out)
    light = (
        tagged.where(F.col("hot").isNull())
        .select(*refs.columns)
        .join(parents.hint("merge"), ["target", "key"], "left")
        .withColumn("fault", _fault())
        .select(*out)
    )
    return (
        heavy.unionByName(light)
        .where(F.col("fault").isNotNull())
        .select(
            "src_table",
            "src_field",
            "row_key",
            F.coalesce(F.date_format("ref_at", "yyyy-MM"), F.lit("unknown")).alias("period"),
            "fault",
        )
        .distinct()
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

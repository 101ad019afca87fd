"""Positions in a document: nearest points, graded moments, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A moment of a talk starts every minute and lasts two (fixed values).
MOMENT_STEP, MOMENT_SPAN = 60, 120


def nearest_point(left: DataFrame, right: DataFrame, doc: str, at: str, point: str) -> DataFrame:
    """``left`` with ``point``: the nearest of the document's points in ``right``,
    the earlier one of two equally near; null without points.

    Both sides pass one window per document: the last point before and the first
    after each row are all that can be nearest, so nothing is paired off."""
    rows = left.select("*", F.col(at).alias("_at")).withColumn("_p", F.lit(None).cast(right.schema[point].dataType))
    points = right.where(F.col(point).isNotNull()).select(doc, F.col(point).alias("_at"), F.col(point).alias("_p")).distinct()
    both = rows.withColumn("_row", F.lit(1)).unionByName(points.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(doc).orderBy("_at", "_row")
    back = Window.partitionBy(doc).orderBy(F.desc("_at"), "_row")
    before = F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(
        F.col("_a").isNull() | (F.col("_at") - F.col("_b") <= F.col("_a") - F.col("_at")), F.col("_b")
    ).otherwise(F.col("_a"))
    return (
        both.withColumn("_b", before).withColumn("_a", after).where(F.col("_row") == 1)
        .withColumn(point, near).drop("_at", "_p", "_row", "_a", "_b")
    )


def contiguous(rows: DataFrame, doc: str, start: str, key: str) -> DataFrame:
    """Adds ``end``: the next start of the document, null for the last."""
    return rows.withColumn("end", F.lead(start).over(Window.partitionBy(doc).orderBy(start, key)))


def moments_of(low: Column, high: Column) -> Column:
    """Starts of the moments that a span of seconds overlaps."""
    first = F.greatest(F.lit(0), F.floor((low - MOMENT_SPAN) / MOMENT_STEP) + 1)
    last = F.floor((high - 1) / MOMENT_STEP)
    return F.when(high > low, F.transform(F.sequence(first, F.greatest(first, last)), lambda m: m * MOMENT_STEP))


def graded_moments(spans: DataFrame, keys: list[str], low: str, high: str, grade: str) -> DataFrame:
    """keys..., moment, grade: every moment has the best grade of its spans."""
    return (
        spans.select(*keys, grade, F.explode(moments_of(F.col(low), F.col(high))).alias("moment"))
        .groupBy(*keys, "moment").agg(F.max(grade).alias(grade))
    )


def sections(lines: DataFrame, doc: str, pos: str, heading: str) -> DataFrame:
    """doc, section_no, heading, first_pos, end_pos: a section starts where the
    heading in force changes and ends where the next one starts (null: open)."""
    order = Window.partitionBy(doc).orderBy(pos)
    changed = ~F.col(heading).eqNullSafe(F.lag(heading).over(order)) & F.col(heading).isNotNull()
    starts = lines.withColumn("_new", changed).where("_new")
    return starts.select(
        doc, F.row_number().over(order).alias("section_no"), F.col(heading).alias("heading"), F.col(pos).alias("first_pos"),
        F.lead(pos).over(order).alias("end_pos"),
    )

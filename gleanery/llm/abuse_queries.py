"""Queries on abusive content (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.abuse import THRESHOLD, abuse_scores
from gleanery.session import table


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of each kind of abuse per document."""
    return abuse_scores(table(spark, sf, "documents"), table(spark, sf, "abuse_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an abusive passage."""
    return p10_scores(spark, sf).where(F.col("any") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of abusive documents per source."""
    return (
        p10_scores(spark, sf)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.count_if(F.col("any") >= THRESHOLD).alias("n_abusive"),
        )
        .withColumn("rate", F.col("n_abusive") / F.col("n_docs"))
    )


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}

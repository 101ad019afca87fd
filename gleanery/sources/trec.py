"""Retrieval test collections: qrels, runs and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, did, grade of a four-column file."""
    parts = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path).where(F.size(parts) == 4)
        .select(parts[0].alias("qid"), parts[2].alias("did"), parts[3].try_cast("int").alias("grade"))
    )


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, did, rank: six-column lines only, re-ranked by the file's rank."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) == 6).select(
        parts[0].alias("qid"), parts[2].alias("did"), parts[3].try_cast("int").alias("r"), parts[4].try_cast("double").alias("score")
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("r", "did"))).drop("r")


def write_qrels(qrels: DataFrame, path: str) -> None:
    if qrels.where("grade IS NULL OR grade < 0").limit(1).count():
        raise ValueError("qrels need grades of 0 or more")
    qrels.select(F.concat_ws(" ", "qid", F.lit("0"), "did", "grade").alias("value")).write.mode("overwrite").text(path)


def write_run(run: DataFrame, path: str, tag: str) -> None:
    run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "did", "rank", "score", F.lit(tag)).alias("value")).write.mode("overwrite").text(path)

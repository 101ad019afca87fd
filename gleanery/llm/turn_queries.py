"""Queries on speech transcripts (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.speaker_turns import speaker_turns
from gleanery.session import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Start and speaker of every turn."""
    return speaker_turns(table(spark, sf, "transcripts")).select("doc_id", "start_ms", "speaker").distinct()


def p4_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn with its clean text."""
    return speaker_turns(table(spark, sf, "transcripts"))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Turns and words per speaker of a talk."""
    return (
        p4_turns(spark, sf)
        .groupBy("doc_id", "speaker")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.sum(F.size(F.split("text", " "))).alias("n_words"),
        )
    )


QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns, "p4_shares": p4_shares}
SQL: dict[str, str] = {}

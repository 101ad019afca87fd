"""Queries on scanned books (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.scan_noise import line_faults, repaired_paragraphs
from gleanery.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Faulty lines of the scanned pages."""
    return line_faults(table(spark, sf, "pdf_facts"))


def p2_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Each book's text in repaired paragraphs."""
    return repaired_paragraphs(table(spark, sf, "pdf_facts"))


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
SQL: dict[str, str] = {}

"""Registry of the core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans import coverage, decisions, evaluation, graph, grounding, integrity, portfolio, retrieval, state, tagging, texts, units, usage, web
from gleanery.streaming import events

MODULES = [integrity, retrieval, units, texts, web, grounding, decisions, tagging, coverage, evaluation, usage, state, portfolio, graph, events]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: dense and lexical lists fused by reciprocal rank."""
    return queries()["hybrid_search_rrf"](spark, sf_dir)

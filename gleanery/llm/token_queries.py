"""Queries on corpus encoding (problem 8)."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.byte_bpe import decode_ids, encode_texts
from gleanery.session import table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: the installed package's folder, or
    the folder the environment variable TOKENIZERS_DIR names."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose decoded ids are their text, per language label."""
    docs = table(spark, sf, "documents")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    back = decode_ids(encode_texts(docs, path), path).withColumnRenamed("text", "decoded")
    return (
        docs.select("doc_id", "lang", "text")
        .join(back, "doc_id")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.count_if(F.coalesce("text", F.lit("")) == F.col("decoded")).alias("n_same"),
        )
    )


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {
    "p8_round_trip": """SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_same
                        FROM documents GROUP BY lang"""
}

"""Queries on similar vectors (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.similar_vectors import nearest, sound
from gleanery.session import table

K = 5
MIN_COSINE = 0.85


def sound_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """space, id, data of the sound vectors of both tables; a model's vectors
    have the length its name ends in, the vectors table's have 64 numbers."""
    plain = table(spark, sf, "vectors").select(
        F.lit("vectors").alias("space"), F.col("n").alias("id"), "data", F.lit(64).alias("length")
    )
    model = F.lower(F.btrim("model", F.lit(" \t\n\r\xa0")))
    named = table(spark, sf, "vecs").select(
        F.concat(F.lit("vecs/"), model).alias("space"), F.col("vec_id").alias("id"), "data",
        F.regexp_extract(model, r"-(\d+)$", 1).try_cast("int").alias("length"),
    )
    rows = plain.unionByName(named)
    return rows.where(
        F.col("space").isNotNull() & F.col("id").isNotNull() & sound(F.col("data"), F.col("length"))
    ).select("space", "id", "data")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cosine 0.85 or more, one among the 5 most similar of the other."""
    near = nearest(sound_vectors(spark, sf), K, MIN_COSINE)
    return near.select(
        F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")
    ).distinct()


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Per space: searched vectors, neighbours found, mean cosine."""
    return (
        nearest(sound_vectors(spark, sf), K, MIN_COSINE)
        .groupBy("space")
        .agg(
            F.countDistinct("id").alias("n_vectors"),
            F.count(F.lit(1)).alias("n_neighbours"),
            F.avg("cosine").alias("mean_cosine"),
        )
    )


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL = {
    "p5_found": r"""
    WITH v AS (
      SELECT DISTINCT 'vectors' AS space, n AS id, CAST(data AS DOUBLE[]) AS d FROM vectors WHERE len(data) = 64
      UNION ALL SELECT DISTINCT 'vecs/' || lower(trim(model)), vec_id, CAST(data AS DOUBLE[]) FROM vecs
      WHERE len(data) = TRY_CAST(regexp_extract(lower(trim(model)), '-(\d+)$', 1) AS INTEGER)
    ), w AS MATERIALIZED (
      SELECT space, id, list_filter(d, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AS d, len(d) AS n FROM v
    ), s AS MATERIALIZED (
      SELECT space, id, d, sqrt(list_dot_product(d, d)) AS size FROM w WHERE len(d) = n
    ), p AS (
      SELECT a.space, a.id, b.id AS other, list_dot_product(a.d, b.d) / (a.size * b.size) AS c
      FROM s a JOIN s b ON a.space = b.space AND a.id <> b.id WHERE a.size > 0 AND b.size > 0
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY space, id ORDER BY c DESC, other) AS rn FROM p WHERE c >= 0.85
    )
    SELECT DISTINCT least(id, other) AS vec_a, greatest(id, other) AS vec_b FROM r WHERE rn <= 5"""
}

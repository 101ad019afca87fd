"""Queries on coverage of questions by their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import coverage as cv
from gleanery.operators.decisions import calibrated
from gleanery.plans import retrieval
from gleanery.session import table

THIS_YEAR, HALF_LIFE_DAYS = 2025, 730


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of each question with their document's source, series
    and year; a vector's label is its domain, whose tier goes by the label."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("domain"))
    docs = table(spark, sf, "documents").select(
        (F.col("doc_id") - retrieval.DOC_BASE).alias("vec_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("source_id"), "series", F.year("published_at").alias("year"),
    )
    tier = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("domain") % 3 + 1)
    return (
        retrieval._dense(spark, sf, 10).join(e, "vec_id").join(docs, "vec_id", "left")
        .select("qid", F.col("vec_id").alias("item_id"), "domain", tier.alias("tier"), "cosine", "doc_id", "source_id", "series", "year",
                calibrated(F.col("cosine"), list(cv.CURVE)).alias("p"), F.lit(None).cast("double").alias("best"))
    )


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Domains a question asks for: its own label and the next one."""
    e = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("qid"), F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("domain"))


def coverage_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level of every domain among a question's hits, and whether the newest
    live hit is stale."""
    return cv.levels(_hits(spark, sf), ["qid", "domain"]).select(
        "qid", "domain", "level", "n_strong", "newest_year", cv.stale(F.col("newest_year"), THIS_YEAR, F.lit(HALF_LIFE_DAYS)).alias("stale")
    )


def coverage_level(spark: SparkSession, sf: str) -> DataFrame:
    """Level of a question over all its hits under the default rule."""
    hits = _hits(spark, sf).withColumn("tier", F.lit(cv.DEFAULT_TIER))
    return cv.levels(hits, ["qid"]).select("qid", "level", "n_strong")


def coverage_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Level of a question over the domains it asks for, those without
    hits counted as none, and the weaker ones."""
    levels = cv.levels(_hits(spark, sf), ["qid", "domain"]).select("qid", "domain", "level")
    got = cv.combined(cv.with_empty(levels, _asked(spark, sf), "qid"), "qid")
    return got.select("qid", "level", F.array_join(F.transform("weak", lambda d: d.cast("string")), ",").alias("weak"))


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with an odd label count as gaps; the curve is moved by the shift."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), (F.col("label") % 2 == 1).alias("is_gap"))
    best = retrieval._dense(spark, sf, 1).select("qid", "cosine").join(e, "qid")
    least = cv.RULES[cv.DEFAULT_TIER][0]

    def level(shift):
        return F.when(calibrated(F.col("cosine") - shift, list(cv.CURVE)) < least, "none").otherwise("some")

    return cv.sweep(best, level)


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Wrongful answers and refusals for every shift of the curve, in millionths."""
    return _sweep(spark, sf).select(
        F.round(F.col("shift") * 100).cast("int").alias("shift_pct"),
        *[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro") for c in ("answered", "refused")],
    )


def recommended_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The shift within both limits that refuses least; no row when none is."""
    return cv.recommended(_sweep(spark, sf)).select(F.round(F.col("shift") * 100).cast("int").alias("shift_pct"))


QUERIES = {f.__name__: f for f in (coverage_levels, coverage_level, coverage_combined, threshold_sweep, recommended_shift)}


def _curve(x: str) -> str:
    parts = [f"WHEN {x} <= {cv.CURVE[0][0]} THEN {cv.CURVE[0][1]}::DOUBLE"]
    for (x0, y0), (x1, y1) in zip(cv.CURVE, cv.CURVE[1:]):
        parts.append(f"WHEN {x} <= {x1}::DOUBLE THEN {y0}::DOUBLE + ({x} - {x0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE) * ({y1}::DOUBLE - {y0}::DOUBLE)")
    return f"CASE {' '.join(parts)} ELSE {cv.CURVE[-1][1]}::DOUBLE END"


_HITS = f"""{retrieval._DENSE.strip()}, h AS (
  SELECT d.qid, d.vec_id, e.label AS domain, ['low', 'medium', 'high'][e.label % 3 + 1] AS tier, d.cosine, CAST(x.doc_id AS VARCHAR) AS doc_id,
    x.source, x.series, year(x.published_at AT TIME ZONE 'UTC') AS yr, {_curve('d.cosine')} AS p
  FROM dense d JOIN embeddings e USING (vec_id) LEFT JOIN documents x ON x.doc_id = d.vec_id + {retrieval.DOC_BASE} WHERE d.rank <= 10)"""


def _levels(tier: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN max(p) < CASE t WHEN 'low' THEN 0.35 ELSE 0.45 END THEN 'none' WHEN n_strong >= 2 THEN 'strong' ELSE 'partial' END AS level,
    n_strong, max(CASE WHEN p >= 0.35 THEN yr END) AS newest_year FROM (
    SELECT *, CASE t WHEN 'low' THEN count(DISTINCT CASE WHEN p >= 0.5 THEN vec_id END) OVER (PARTITION BY {by})
      WHEN 'medium' THEN count(DISTINCT CASE WHEN p >= 0.6 THEN coalesce(doc_id, '?') END) OVER (PARTITION BY {by})
      ELSE count(DISTINCT CASE WHEN p >= 0.7 THEN coalesce(source, doc_id, '?') || '|' || coalesce(series, '') END) OVER (PARTITION BY {by}) END AS n_strong
    FROM (SELECT *, {tier} AS t FROM h)) GROUP BY {by}, t, n_strong"""


_SHIFTS = ", ".join(f"({i}, {s}::DOUBLE)" for i, s in zip(range(-12, 13, 2), cv.SHIFTS))
_RATES = f"""{retrieval._DENSE.strip()}, b AS (SELECT d.qid, d.cosine, e.label % 2 = 1 AS gap FROM dense d JOIN embeddings e ON e.vec_id = d.qid WHERE d.rank = 1),
r AS (SELECT pct, s, count(*) FILTER (gap AND p >= 0.45) / nullif(count(*) FILTER (gap), 0) AS answered, count(*) FILTER (NOT gap AND p < 0.45) / nullif(count(*) FILTER (NOT gap), 0) AS refused
  FROM (SELECT pct, s, gap, {_curve('(cosine - s)')} AS p FROM b, (VALUES {_SHIFTS}) v(pct, s)) GROUP BY ALL)"""
SQL = {
    "coverage_levels": f"WITH {_HITS} SELECT *, coalesce(({THIS_YEAR} - newest_year) * 365.25 > {HALF_LIFE_DAYS}, false) AS stale FROM ({_levels('tier', 'qid, domain')})",
    "coverage_level": f"WITH {_HITS} SELECT qid, level, n_strong FROM ({_levels(chr(39) + 'medium' + chr(39), 'qid')})",
    "coverage_combined": f"""WITH {_HITS}, l AS ({_levels('tier', 'qid, domain')}),
        a AS (SELECT vec_id AS qid, unnest([label, (label + 1) % 10]) AS domain FROM embeddings WHERE vec_id % 100 = 0),
        w AS (SELECT a.qid, a.domain, coalesce(level, 'none') AS level FROM a LEFT JOIN l USING (qid, domain)),
        o AS (SELECT *, CASE level WHEN 'strong' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS k, max(CASE level WHEN 'strong' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS top FROM w)
        SELECT qid, CASE WHEN min(k) = 2 THEN 'strong' WHEN max(k) = 0 THEN 'none' ELSE 'partial' END AS level,
          coalesce(string_agg(CAST(domain AS VARCHAR), ',' ORDER BY domain) FILTER (k < top), '') AS weak FROM o GROUP BY qid""",
    "threshold_sweep": f"WITH {_RATES} SELECT pct AS shift_pct, CAST(floor(answered * 1e6 + 0.5) AS BIGINT) AS answered_micro, CAST(floor(refused * 1e6 + 0.5) AS BIGINT) AS refused_micro FROM r",
    "recommended_shift": f"WITH {_RATES} SELECT pct AS shift_pct FROM r WHERE answered <= 0.10 AND refused <= 0.15 ORDER BY refused, answered, abs(s), s LIMIT 1",
}

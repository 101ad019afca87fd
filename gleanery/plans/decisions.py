"""Queries on coverage, calibration, routing, tagging and their statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import decisions as dec
from gleanery.plans.dialect import plans
from gleanery.plans.retrieval import _dense
from gleanery.session import table

_TAGS = """
 tags AS (SELECT DISTINCT item_id, doc_id, kind, [[rows:topics]] AS topic FROM {items}),
 n AS (SELECT doc_id, topic, count(*) AS c FROM tags WHERE doc_id NOT IN ('', '-1') GROUP BY doc_id, topic),
 m AS (SELECT doc_id, count(*) AS total FROM (SELECT DISTINCT doc_id, item_id FROM tags) t GROUP BY doc_id),
 s AS (SELECT n.doc_id, n.topic, n.c, m.total, [[div:n.c * 2000 + m.total¦m.total * 2]] AS share_milli FROM n JOIN m ON m.doc_id = n.doc_id)
"""
TEXTS = {
    "document_domain_shares": f"""-- A13 Q8: share of a document's tagged items per topic (rounded first), kept from 300 thousandths on with two items or half
        WITH {_TAGS} SELECT doc_id, topic, CAST(c AS BIGINT) AS n, CAST(share_milli AS BIGINT) AS share_milli FROM s WHERE share_milli >= 300 AND (c >= least(2, total) OR share_milli >= 500)""",
    "tag_precision_recall": f"""-- A14 A20: micro counts of document topics against the topics of its first item
        WITH {_TAGS}, want AS (SELECT DISTINCT doc_id, topic FROM (SELECT doc_id, topic, dense_rank() OVER (PARTITION BY doc_id ORDER BY item_id) AS r FROM tags WHERE doc_id NOT IN ('', '-1')) x WHERE r = 1),
        have AS (SELECT doc_id, topic FROM s WHERE share_milli >= 300)
        SELECT CAST(sum(CASE WHEN h.topic IS NOT NULL AND w.topic IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN w.topic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp,
          CAST(sum(CASE WHEN h.topic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM have h FULL JOIN want w ON w.doc_id = h.doc_id AND w.topic = h.topic""",
    "high_tier_confirm": f"""-- C10 C14: documents whose leading topic holds two thirds of all items
        WITH {_TAGS} SELECT doc_id, topic FROM s WHERE c * 3 >= total * 2""",
    "tag_candidates": f"""-- W26 C9: topics of a document within a fifth of its best, in order
        WITH {_TAGS}, b AS (SELECT *, max(c) OVER (PARTITION BY doc_id) AS best FROM s)
        SELECT doc_id, topic, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, topic) AS BIGINT) AS rn FROM b WHERE c * 5 >= best * 4""",
    "declared_domains": f"""-- C4 U14: declared topics with their items, empty ones count as none
        WITH {_TAGS}, d AS (SELECT 'pricing' AS topic UNION ALL SELECT 'hiring' UNION ALL SELECT 'astronomy')
        SELECT d.topic, CAST(count(tags.item_id) AS BIGINT) AS n, CASE WHEN count(tags.item_id) = 0 THEN 'none' ELSE 'some' END AS level FROM d LEFT JOIN tags ON tags.topic = d.topic GROUP BY d.topic""",
}
QUERIES, SQL = plans(TEXTS)


def _neighbours(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return _dense(spark, sf, 50).join(e, "vec_id").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel")), "qid")


def domain_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the three best cosines of every label over all vectors, in millionths."""
    return (
        _dense(spark, sf, 3, group="label")
        .groupBy("qid", "label").agg(F.floor(F.avg("cosine") * 1e6).cast("long").alias("score_micro"))
    )


def route_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Labels within a margin of the best, at most three, none if single."""
    best = F.max("score_micro").over(Window.partitionBy("qid"))
    order = Window.partitionBy("qid").orderBy(F.desc("score_micro"), "label")
    return (
        domain_scores(spark, sf).withColumn("best", best).where("score_micro >= best - 150000")
        .withColumn("rank", F.row_number().over(order)).where("rank <= 3")
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid"))).where("n >= 2")
        .select("qid", "label", "rank")
    )


def route_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose own label is routed to."""
    q = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    return (
        q.join(route_choice(spark, sf).select("qid", "label", "rank"), ["qid", "label"], "left")
        .agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("n_hit"), F.count_if(F.col("rank") == 1).alias("n_first"))
    )


def _pairs(spark, sf) -> DataFrame:
    return _neighbours(spark, sf).select("qid", "cosine", (F.col("label") == F.col("qlabel")).cast("int").alias("y"))


def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Knots of the calibration curve of similarity against label match, in millionths."""
    knots = dec.isotonic_fit(_pairs(spark, sf), "cosine", "y") or []
    micro = [(i, math.floor(x * 1e6 + 0.5), math.floor(y * 1e6 + 0.5)) for i, (x, y) in enumerate(knots)]
    return spark.createDataFrame(micro, "knot int, x_micro long, y_micro long")


def calibrated_probability(spark: SparkSession, sf: str) -> DataFrame:
    """M7: calibrated probability of every neighbour under a fixed curve, in millionths."""
    knots = [(0.2, 0.05), (0.4, 0.3), (0.6, 0.7), (0.8, 0.95)]
    return _neighbours(spark, sf).select("qid", "vec_id", F.floor(dec.calibrated(F.col("cosine"), knots) * 1e6).cast("long").alias("p_micro"))


def brier_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of the curve of the other fold, over scored rows."""
    folds = _pairs(spark, sf).withColumn("fold", (F.col("qid") / 100).cast("int") % 2)
    out = None
    for f in (0, 1):
        knots = dec.isotonic_fit(folds.where(F.col("fold") != f), "cosine", "y")
        if knots is None:
            continue
        part = folds.where(F.col("fold") == f).select("fold", F.pow(dec.calibrated(F.col("cosine"), knots) - F.col("y"), 2).alias("e"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "fold int, n long, brier_micro long")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("e") * 1e6 + 0.5).cast("long").alias("brier_micro"))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """15 left-open bins of the similarity."""
    bins = dec.calibration_error(_pairs(spark, sf).withColumn("p", F.greatest(F.lit(0.0), "cosine")), "p", "y")
    return bins.select("bin", "n", *[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro") for c in ("mean_p", "mean_y")])


def leader_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Leader clusters of the embeddings."""
    return dec.leader_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", near=0.3, least=5)


def paired_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap interval of the neighbours' mean label match, and the
    exact test of the questions above against those below chance."""
    rows = _pairs(spark, sf).groupBy("qid").agg(F.avg("y").alias("v"))
    tail = F.udf(lambda a, b: dec.binomial_tail(int(a), int(b)), "double")  # one row
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 0.1).alias("wins"))
    return counts.join(dec.bootstrap(rows, "qid", "v", 1000)).select(
        "n", *[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro") for c in ("low", "high")],
        F.floor(tail("wins", F.col("n") - F.col("wins")) * 1e6 + 0.5).cast("long").alias("p_micro"),
    )


QUERIES |= {
    f.__name__: f
    for f in (
        domain_scores, route_choice, route_eval, isotonic_fit, calibrated_probability, brier_by_fold,
        calibration_bins, leader_clusters, paired_statistics,
    )
}
_NB = """dn AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
al AS (SELECT q.vec_id AS qid, q.label AS qlabel, x.vec_id, x.label,
    list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v))) AS cosine,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v))) DESC, x.vec_id) AS rank
  FROM dn q, dn x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
nb AS (SELECT * FROM al WHERE rank <= 50),
ds AS (SELECT qid, label, CAST(floor(avg(cosine) * 1e6) AS BIGINT) AS score_micro FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY cosine DESC, vec_id) AS n FROM al) WHERE n <= 3 GROUP BY ALL),
rc AS (SELECT qid, label, rank FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (
  SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score_micro DESC, label) AS rank FROM (
    SELECT *, max(score_micro) OVER (PARTITION BY qid) AS best FROM ds) WHERE score_micro >= best - 150000) WHERE rank <= 3) WHERE n >= 2)"""
_P = """CASE WHEN cosine <= 0.2 THEN 0.05 WHEN cosine <= 0.4 THEN 0.05::DOUBLE + (cosine - 0.2::DOUBLE) / (0.4::DOUBLE - 0.2::DOUBLE) * (0.3::DOUBLE - 0.05::DOUBLE)
  WHEN cosine <= 0.6 THEN 0.3::DOUBLE + (cosine - 0.4::DOUBLE) / (0.6::DOUBLE - 0.4::DOUBLE) * (0.7::DOUBLE - 0.3::DOUBLE)
  WHEN cosine <= 0.8 THEN 0.7::DOUBLE + (cosine - 0.6::DOUBLE) / (0.8::DOUBLE - 0.6::DOUBLE) * (0.95::DOUBLE - 0.7::DOUBLE) ELSE 0.95 END"""
SQL |= {
    "domain_scores": f"WITH {_NB} SELECT * FROM ds",
    "route_choice": f"WITH {_NB} SELECT * FROM rc",
    "route_eval": f"""WITH {_NB} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(rank) AS BIGINT) AS n_hit, CAST(count(*) FILTER (rank = 1) AS BIGINT) AS n_first
        FROM (SELECT vec_id AS qid, label FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN rc ON rc.qid = q.qid AND rc.label = q.label""",
    "calibrated_probability": f"WITH {_NB} SELECT qid, vec_id, CAST(floor(({_P}) * 1e6) AS BIGINT) AS p_micro FROM nb",
}
_PAIRS = f"{_NB}, pr AS (SELECT qid, cosine AS s, CASE WHEN label = qlabel THEN 1 ELSE 0 END AS y FROM nb)"


def _knots(rows: str) -> str:
    """Bins of equal counts and the non-decreasing fit as a max of mins."""
    return f"""ra AS (SELECT s, y, row_number() OVER (ORDER BY s, y) - 1 AS r, count(*) OVER () AS n FROM {rows}),
    nb_ AS (SELECT *, least(16, greatest(2, n // 10)) AS k FROM ra),
    bi AS (SELECT s, y, len(list_filter(range(1, k), lambda i: r >= CAST(round_even(i * n / k, 0) AS BIGINT))) AS bin FROM nb_),
    bn AS (SELECT bin, avg(s) AS x, avg(y) AS y, count(*) AS n, row_number() OVER (ORDER BY bin) AS i FROM bi GROUP BY bin),
    mm AS (SELECT a.i, b.i AS k, (SELECT sum(y * n) / sum(n) FROM bn c WHERE c.i BETWEEN a.i AND b.i) AS m FROM bn a JOIN bn b ON b.i >= a.i),
    ft AS (SELECT bn.i, (SELECT max(low) FROM (SELECT mm.i AS j, min(m) AS low FROM mm WHERE mm.i <= bn.i AND mm.k >= bn.i GROUP BY mm.i)) AS fit FROM bn),
    lv AS (SELECT bn.*, fit, sum(CASE WHEN prev IS NULL OR abs(fit - prev) > 1e-8 + 1e-5 * 0 THEN 1 ELSE 0 END) OVER (ORDER BY bn.i) AS level
      FROM bn JOIN (SELECT *, lag(fit) OVER (ORDER BY i) AS prev FROM ft) ft ON ft.i = bn.i),
    pt AS (SELECT level, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y FROM lv GROUP BY level)"""


SQL |= {
    "isotonic_fit": f"WITH {_PAIRS}, {_knots('pr')} SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS knot, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS x_micro, CAST(floor(y * 1e6 + 0.5) AS BIGINT) AS y_micro FROM pt",
    "calibration_bins": f"""WITH {_PAIRS}, p AS (SELECT greatest(0, s) AS p, y FROM pr)
        SELECT CAST(greatest(0, ceil(p * 15) - 1) AS INTEGER) AS bin, count(*) AS n, CAST(floor(avg(p) * 1e6 + 0.5) AS BIGINT) AS mean_p_micro, CAST(floor(avg(y) * 1e6 + 0.5) AS BIGINT) AS mean_y_micro FROM p GROUP BY ALL""",
    "paired_statistics": f"""WITH {_PAIRS}, v AS (SELECT qid, avg(y) AS v, CAST(floor(avg(y) * 1e6 + 0.5) AS BIGINT) AS micro FROM pr GROUP BY qid),
        rp AS (SELECT v.*, r, CAST('0x' || substr(sha256('42:' || r || ':' || qid), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM v, range(1, 1001) t(r)),
        mn AS (SELECT r, sum(w * micro) / sum(w) / 1e6::DOUBLE AS m FROM (SELECT r, micro, {' + '.join(f'CASE WHEN u >= {b!r}::DOUBLE THEN 1 ELSE 0 END' for b in dec.POISSON_BOUNDS)} AS w FROM rp) GROUP BY r HAVING sum(w) > 0),
        ci AS (SELECT list_sort(list(m)) AS ms FROM mn), c AS (SELECT count(*) AS n, count(*) FILTER (v > 0.1) AS wins FROM v),
        p AS (SELECT least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) AS p FROM c, range(0, 100000) t(i) WHERE i <= least(wins, n - wins))
        SELECT n, CAST(floor(ms[CAST(floor(len(ms) * 0.025) AS BIGINT) + 1] * 1e6 + 0.5) AS BIGINT) AS low_micro,
          CAST(floor(ms[least(len(ms) - 1, CAST(floor(len(ms) * 0.975) AS BIGINT)) + 1] * 1e6 + 0.5) AS BIGINT) AS high_micro, CAST(floor(p * 1e6 + 0.5) AS BIGINT) AS p_micro FROM c, ci, p""",
}


def _fold_sql(fold: int) -> str:
    """Squared errors of a fold's rows under the curve of the other fold's knots."""
    return f"""SELECT {fold} AS fold, s, y, p FROM (WITH o AS (SELECT s, y FROM pr WHERE CAST(qid / 100 AS INTEGER) % 2 <> {fold}), {_knots('o')},
      kn AS (SELECT *, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, min(x) OVER () AS lo, max(x) OVER () AS hi FROM pt)
      SELECT pr.s, pr.y, (SELECT max(CASE WHEN pr.s <= lo AND x = lo THEN kn.y WHEN pr.s > hi AND x = hi THEN kn.y WHEN pr.s > x AND pr.s <= x1 THEN kn.y + (pr.s - x) / (x1 - x) * (y1 - kn.y) END) FROM kn) AS p
      FROM pr WHERE CAST(qid / 100 AS INTEGER) % 2 = {fold} AND (SELECT count(*) FROM pt) >= 2 AND (SELECT count(*) FROM o) >= 50)"""


SQL["brier_by_fold"] = f"""WITH {_PAIRS}, e AS ({_fold_sql(0)} UNION ALL {_fold_sql(1)})
    SELECT fold, count(*) AS n, CAST(floor(avg(pow(p - y, 2)) * 1e6 + 0.5) AS BIGINT) AS brier_micro FROM e GROUP BY fold"""

"""Plans on evaluation: judgments, metrics and their statistics.

The runs are the retrieval queries' own: dense, lexical and fused lists of the
question set over the whole collection. Judgments are the pool of the systems
(at most 100 rows a question): a vector of the question's label has grade 1 to
3, others 0, every seventh is unjudged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import decisions as dec
from gleanery.operators import metrics as me
from gleanery.plans import retrieval
from gleanery.plans.dialect import plans
from gleanery.session import cut_lineage, table


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """qid, did, rank of the fused list, dense_rank, sparse_rank, label, qlabel, grade."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("did"), "label")
    q = e.select(F.col("did").alias("qid"), F.col("label").alias("qlabel"))
    # the join with q drops the lists of questions without a vector: they are not searched
    found = retrieval._fused(spark, sf, q.select("qid")).withColumnRenamed("vec_id", "did").join(e, "did").join(q, "qid")
    grade = F.when(F.col("did") % 7 == 0, None).when(F.col("label") == F.col("qlabel"), 1 + F.col("did") % 3).otherwise(0)
    return found.select("qid", "did", "rank", "dense_rank", "sparse_rank", "label", "qlabel", grade.cast("int").alias("grade"))


_POOL = retrieval._FUSED.strip() + """, pool AS (
  SELECT f.qid, f.vec_id AS did, f.rank, f.dense_rank, f.sparse_rank, e.label, q.label AS qlabel,
    CASE WHEN f.vec_id % 7 = 0 THEN NULL WHEN e.label = q.label THEN 1 + f.vec_id % 3 ELSE 0 END AS grade
  FROM fused f JOIN embeddings e ON e.vec_id = f.vec_id JOIN embeddings q ON q.vec_id = f.qid WHERE f.rank <= 50)"""
_MICRO = "CAST(floor(({0}) * 1000000 + 0.5) AS BIGINT)"
_QRELS = "qrels AS (SELECT qid, did, grade, label, qlabel FROM {pool} WHERE grade IS NOT NULL)"

TEXTS = {
    "recall_ceiling": f"""-- V7: mean of min(k, R) / R per mille over questions with a relevant row
        WITH {_QRELS}, rel AS (SELECT qid, count(*) AS n FROM qrels WHERE grade >= 1 GROUP BY qid)
        SELECT k, CAST(sum([[div:least(k, n) * 1000¦n]]) AS BIGINT) AS permille_sum, CAST(count(*) AS BIGINT) AS n_q
        FROM rel CROSS JOIN (SELECT 10 AS k UNION ALL SELECT 50) ks GROUP BY k""",
    "doc_qrels": f"""-- A15: a document's grade is the best of its moments
        WITH {_QRELS} SELECT qid, [[div:did¦5]] AS doc, CAST(max(grade) AS BIGINT) AS grade FROM qrels GROUP BY qid, [[div:did¦5]]""",
    "kind_mix": """-- A16: share of each label among all first tens, in ten-thousandths
        WITH c AS (SELECT label AS kind, count(*) AS n FROM {pool} WHERE rank <= 10 GROUP BY label), t AS (SELECT kind, n, sum(n) OVER () AS total FROM c)
        SELECT kind, CAST(n AS BIGINT) AS n, CAST([[div:n * 20000 + total¦total * 2]] AS BIGINT) AS share FROM t""",
    "pool_union": """-- W29 E6: pool of the two systems: best rank, systems that found it; seeds enter at 999
        WITH p AS (SELECT qid, did, dense_rank, sparse_rank FROM {pool}), two AS (SELECT qid, did, dense_rank AS rank, 'dense' AS variant FROM p WHERE dense_rank IS NOT NULL
          UNION ALL SELECT qid, did, sparse_rank, 'sparse' FROM p WHERE sparse_rank IS NOT NULL UNION ALL SELECT qid, qid, 999, 'seed' FROM p)
        SELECT qid, did, CAST(min(rank) AS BIGINT) AS best_rank, [[joined:[[sorted:[[distinct:[[list:variant]]]]]]¦',']] AS systems FROM two GROUP BY qid, did""",
    "results_to_moments": """-- W28 X8 E4: ranked rows mapped to moments, first rank wins, re-ranked, ten kept
        WITH m AS (SELECT qid, [[div:did¦5]] AS moment, min(rank) AS r FROM {pool} GROUP BY qid, [[div:did¦5]]),
        n AS (SELECT qid, moment, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM m)
        SELECT qid, moment, CAST(rank AS BIGINT) AS rank FROM n WHERE rank <= 10""",
    "reachability": f"""-- A23: relevant judgments that the dense list can return
        WITH {_QRELS}, d AS (SELECT qid, did FROM {{pool}} WHERE dense_rank IS NOT NULL)
        SELECT q.qid, CAST(count(*) AS BIGINT) AS n_rel, CAST(count(d.did) AS BIGINT) AS n_reachable
        FROM qrels q LEFT JOIN d ON d.qid = q.qid AND d.did = q.did WHERE q.grade >= 2 GROUP BY q.qid""",
    "popularity": f"""-- A19: head, torso and tail questions by relevant rows
        WITH {_QRELS}, n AS (SELECT qid, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS c FROM qrels GROUP BY qid)
        SELECT qid, CAST(c AS BIGINT) AS n_relevant, CASE WHEN c >= 10 THEN 'head' WHEN c >= 3 THEN 'torso' ELSE 'tail' END AS band FROM n""",
    "question_overlap": """-- E2 V12: questions shared by, new in and retired from the dense and the lexical run
        WITH a AS (SELECT DISTINCT qid FROM {pool} WHERE dense_rank IS NOT NULL), b AS (SELECT DISTINCT qid FROM {pool} WHERE sparse_rank IS NOT NULL)
        SELECT CASE WHEN a.qid IS NULL THEN 'new' WHEN b.qid IS NULL THEN 'retired' ELSE 'shared' END AS state, CAST(count(*) AS BIGINT) AS n
        FROM a FULL JOIN b ON a.qid = b.qid GROUP BY 1""",
    "decided_split": f"""-- V17 V18: questions whose best judgment is at least 2, up to a fifth of all, spare beyond, discarded below
        WITH {_QRELS}, q AS (SELECT qid, max(grade) AS top, count(*) AS n_judged FROM qrels GROUP BY qid),
        o AS (SELECT *, row_number() OVER (PARTITION BY top >= 2 ORDER BY [[sha:concat('42:', CAST(qid AS VARCHAR(20)))]]) AS rn, count(*) OVER () AS n FROM q)
        SELECT qid, CASE WHEN top < 2 THEN 'discarded' WHEN rn <= greatest(1, [[div:n¦5]]) THEN 'kept' ELSE 'spare' END AS state FROM o""",
    "holm_adjust": """-- V11: Holm step-down of the p values of twelve tests (millionths)
        WITH p AS (SELECT event_type, [[div:[[epoch:ts]]¦86400]] % 7 AS day, count(*) AS n FROM {events} GROUP BY event_type, [[div:[[epoch:ts]]¦86400]] % 7),
        t AS (SELECT event_type, day, (n * 7919 + day * 104729) % 1000000 AS p FROM p),
        r AS (SELECT *, row_number() OVER (ORDER BY p, event_type, day) AS i, count(*) OVER () AS m FROM t)
        SELECT event_type, day, CAST(p AS BIGINT) AS p_micro,
          CAST(least(1000000, max(p * (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS holm_micro FROM r""",
    "wilson_rates": f"""-- M8 A21: share of abusive labels per rater with its Wilson interval, in millionths
        WITH n AS (SELECT rater, CAST(sum(abusive) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT * FROM {{abuse_labels}}) l GROUP BY rater),
        w AS (SELECT rater, k, n, k / n AS p, 1.96 * 1.96 AS z2 FROM n)
        SELECT rater, CAST(n AS BIGINT) AS n,
          {_MICRO.format('greatest(0.0, (p + z2 / (2 * n) - 1.96 * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))')} AS low,
          {_MICRO.format('least(1.0, (p + z2 / (2 * n) + 1.96 * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))')} AS high FROM w""",
    "final_grade": """-- M14: two grades agree within one: the lower; else the median of three; null while open
        WITH g AS (SELECT vec_id, CAST(vec_id % 4 AS BIGINT) AS a, CAST(vec_id * 7 % 4 AS BIGINT) AS b,
                     CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id * 3 % 4 AS BIGINT) END AS c FROM {embeddings})
        SELECT vec_id, CASE WHEN abs(a - b) < 2 THEN least(a, b) WHEN c IS NULL THEN NULL
          ELSE a + b + c - greatest(a, b, c) - least(a, b, c) END AS grade FROM g""",
    "kappa": """-- V19: Cohen's kappa of every two raters over the documents both labelled, in millionths
        WITH l AS (SELECT doc_id, rater, max(abusive) AS v FROM {abuse_labels} WHERE rater IS NOT NULL AND abusive IS NOT NULL GROUP BY doc_id, rater),
        c AS (SELECT a.rater AS rater_a, b.rater AS rater_b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS DOUBLE) AS agree,
          CAST(sum(a.v) AS DOUBLE) AS ya, CAST(sum(b.v) AS DOUBLE) AS yb FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY a.rater, b.rater),
        k AS (SELECT rater_a, rater_b, n, agree / n AS po, (ya * yb + (n - ya) * (n - yb)) / (n * n) AS pe FROM c)
        SELECT rater_a, rater_b, CAST(n AS BIGINT) AS n, CASE WHEN pe < 1 THEN CAST(floor((po - pe) / (1 - pe) * 1000000 + 0.5) AS BIGINT) END AS kappa_micro FROM k""",
    "fleiss": """-- V19: Fleiss' kappa of documents with exactly two labels, in millionths
        WITH l AS (SELECT doc_id, rater, max(abusive) AS v FROM {abuse_labels} WHERE rater IS NOT NULL AND abusive IS NOT NULL GROUP BY doc_id, rater),
        d AS (SELECT doc_id, CAST(sum(v) AS DOUBLE) AS yes FROM l GROUP BY doc_id HAVING count(*) = 2),
        t AS (SELECT CAST(count(*) AS DOUBLE) AS m, avg((yes * (yes - 1) + (2 - yes) * (1 - yes)) / 2) AS po, sum(yes) / (2 * CAST(count(*) AS DOUBLE)) AS p FROM d)
        SELECT CAST(m AS BIGINT) AS n, CASE WHEN p * p + (1 - p) * (1 - p) < 1
          THEN CAST(floor((po - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))) * 1000000 + 0.5) AS BIGINT) END AS kappa_micro FROM t""",
    "majority_label": """-- V24 V25 V26: majority of the labels of a document, contested = null
        WITH n AS (SELECT doc_id, sum(abusive) AS yes, count(*) AS n FROM (SELECT DISTINCT * FROM {abuse_labels}) l GROUP BY doc_id)
        SELECT doc_id, CAST(CASE WHEN yes * 2 > n THEN 1 WHEN yes * 2 < n THEN 0 END AS BIGINT) AS label, CAST(n AS BIGINT) AS n FROM n""",
    "f1_by_class": """-- V22 A14: F1 of each rater against the majority by class, and the mean over the classes, in millionths
        WITH l AS (SELECT DISTINCT * FROM {abuse_labels}), m AS (SELECT doc_id, CASE WHEN sum(abusive) * 2 > count(*) THEN 1 ELSE 0 END AS truth FROM l GROUP BY doc_id)
        SELECT rater, cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
          CAST([[div:2000000 * tp¦greatest(1, 2 * tp + fp + fn)]] AS BIGINT) AS f1_micro,
          CAST([[div:[[div:2000000 * tp¦greatest(1, 2 * tp + fp + fn)]] + [[div:2000000 * tn¦greatest(1, 2 * tn + fp + fn)]]¦2]] AS BIGINT) AS macro_micro FROM (
          SELECT rater, cls, sum(CASE WHEN abusive = cls AND truth = cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN abusive = cls AND truth <> cls THEN 1 ELSE 0 END) AS fp,
            sum(CASE WHEN abusive <> cls AND truth = cls THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN abusive <> cls AND truth <> cls THEN 1 ELSE 0 END) AS tn
          FROM l JOIN m ON l.doc_id = m.doc_id CROSS JOIN (SELECT 0 AS cls UNION ALL SELECT 1) c GROUP BY rater, cls) x""",
    "split_target": """-- V18 V17: target of a split per source: a fifth of its documents, seeded first
        WITH d AS (SELECT coalesce(source, '') AS source, doc_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY
              [[sha:concat('42:', CAST(doc_id AS VARCHAR(20)))]]) AS rn, count(*) OVER (PARTITION BY coalesce(source, '')) AS n FROM {documents})
        SELECT source, doc_id FROM d WHERE rn <= [[div:n¦5]]""",
    "hash_sample": """-- W34 C13 V16: ten smallest seeded hashes of each source
        SELECT source, doc_id, CAST(rn AS BIGINT) AS rn FROM (SELECT coalesce(source, '') AS source, doc_id, row_number() OVER (PARTITION BY coalesce(source, '')
          ORDER BY [[sha:concat('7:', CAST(doc_id AS VARCHAR(20)))]]) AS rn FROM {documents}) d WHERE rn <= 10""",
    "proportional_allocation": """-- W36 W39: 100 draws over sources, floors first, remainders by size then name
        WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM {documents} GROUP BY coalesce(source, '')),
        s AS (SELECT source, n, sum(n) OVER () AS total FROM n),
        f AS (SELECT source, n, [[div:100 * n¦total]] AS base, (100 * n) % total AS rest FROM s),
        r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS rn, 100 - sum(base) OVER () AS spare FROM f)
        SELECT source, CAST(least(n, base + CASE WHEN rn <= spare THEN 1 ELSE 0 END) AS BIGINT) AS n_drawn FROM r""",
    "round_robin": """-- W31 W32: documents of the sources in turn
        SELECT source, doc_id, CAST(turn AS BIGINT) AS turn FROM (SELECT coalesce(source, '') AS source, doc_id,
          row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS turn FROM {documents}) d
        ORDER BY turn, source, doc_id LIMIT 200""",
    "gate_score": """-- A22 A8: supported share of claims per kind of item, incomplete ones never pass
        SELECT kind, CAST(count(*) AS BIGINT) AS claims, CAST(sum(CASE WHEN evidence IS NOT NULL AND evidence <> '' THEN 1 ELSE 0 END) AS BIGINT) AS supported
        FROM (SELECT DISTINCT item_id, kind, evidence FROM {items}) i GROUP BY kind""",
    "latency_gate": """-- V28: tools whose 95th percentile exceeds the limit
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {events})
        SELECT event_type, max(CASE WHEN rn = 1 + [[nth95:n]] THEN value END) > 90 AS too_slow FROM r GROUP BY event_type""",
    "state_checks": """-- V29: least and most live rows per founder against fixed bounds
        SELECT founder_id, CAST(count(*) AS BIGINT) AS n, count(*) BETWEEN 1 AND 20 AS ok
        FROM (SELECT DISTINCT id, founder_id FROM {goals} WHERE deleted_at IS NULL) g GROUP BY founder_id""",
}
QUERIES, SQL = plans(TEXTS, {"pool": (pool, _POOL)})


def _scored(spark: SparkSession, sf: str, run: str, k: int = 10, least: int = 1, p: DataFrame | None = None) -> DataFrame:
    p = pool(spark, sf) if p is None else p
    runs = p.where(F.col(run).isNotNull()).select("qid", "did", F.col(run).alias("rank"))
    return me.per_query(runs, p.where("grade IS NOT NULL").select("qid", "did", "grade"), k, least)


def _micro(c: str):
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long")


def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """nDCG@10 of the fused run, in millionths, plain and strict."""
    a = _scored(spark, sf, "rank").select("qid", _micro("ndcg").alias("ndcg_micro"))
    return a.join(_scored(spark, sf, "rank", least=2).select("qid", _micro("ndcg").alias("strict_micro")), "qid")


def recall_mrr_judged(spark: SparkSession, sf: str) -> DataFrame:
    """V2 V3 V4: recall, reciprocal rank and judged share at 10 of the fused run, in millionths."""
    return _scored(spark, sf, "rank").select("qid", *[_micro(c).alias(f"{c}_micro") for c in ("recall", "mrr", "judged")])


def condensed_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    """V5: nDCG@10 of the judged rows only, re-ranked, over the ideal, in millionths."""
    return _scored(spark, sf, "rank").select("qid", _micro("condensed").alias("condensed_micro"))


def facet_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean nDCG@10 per label of the question, in millionths of exact sums."""
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("facet"))
    return _scored(spark, sf, "rank").select("qid", _micro("ndcg").alias("m")).join(q, "qid").groupBy("facet").agg(
        F.count(F.lit(1)).alias("n_q"), F.floor(F.sum("m") / F.count(F.lit(1))).cast("long").alias("mean_micro")
    )


def run_comparison(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    """Fused against dense run per metric: mean difference, its
    bootstrap interval, randomisation p (Holm among the secondary metrics) and gate."""
    p = cut_lineage(pool(spark, sf)) if p is None else p  # read by every metric of both runs
    current, base = (cut_lineage(_scored(spark, sf, run, p=p)) for run in ("rank", "dense_rank"))
    out = None
    for metric in ("ndcg", "recall", "mrr"):
        rows = me.paired(current, base, metric)
        one = (
            rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(_micro("diff")) / F.count(F.lit(1)) / 1e6).alias("delta"))
            .join(dec.bootstrap(rows, "qid", "diff", 1000)).join(dec.randomization_p(rows, "qid", "diff", 1000))
            .select(F.lit(metric).alias("metric"), "*")
        )
        out = one if out is None else out.unionByName(one)
    adjusted = F.when(F.col("metric") == "ndcg", F.col("p")).otherwise(F.least(F.lit(1.0), F.col("holm")))
    ranked = out.withColumn("i", F.expr("row_number() OVER (PARTITION BY metric = 'ndcg' ORDER BY p, metric)"))
    step = ranked.withColumn("step", F.col("p") * (3 - F.col("i"))).withColumn(
        "holm", F.expr("max(step) OVER (PARTITION BY metric = 'ndcg' ORDER BY i)")
    )
    gate = F.coalesce(*[F.when(F.col("metric") == m, F.col("delta") < -g) for m, g in me.GATE.items()], F.lit(False))
    return step.select("metric", "n", *[_micro(c).alias(c) for c in ("delta", "low", "high")], F.floor(adjusted * 1e6 + 0.5).cast("long").alias("p"), gate.alias("fails_gate"))


def run_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the fused run, and the hash of the judgments it used."""
    p = cut_lineage(pool(spark, sf))
    labels = me.labels_hash(p.where("grade IS NOT NULL"), buckets=1)
    judged = _scored(spark, sf, "rank", p=p).agg(F.avg("judged")).scalar()
    compared = run_comparison(spark, sf, p)
    return me.verdict(compared, judged, F.lit(True)).join(labels)


QUERIES |= {f.__name__: f for f in (ndcg_at_k, recall_mrr_judged, condensed_ndcg, facet_means, run_comparison, run_verdict)}


def _metrics_sql(run: str, least: int = 1) -> str:
    g = f"CASE WHEN grade >= {least} THEN grade ELSE 0 END"
    return f"""jd AS (SELECT qid, did, {run} AS rk, grade FROM pool WHERE {run} IS NOT NULL),
  idl AS (SELECT qid, sum(CASE WHEN i <= 10 THEN ({g}) / log2(i + 1) END) AS ideal, count(*) FILTER (grade >= {least}) AS n_rel, max(grade) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS i FROM pool WHERE grade IS NOT NULL) GROUP BY qid),
  sh AS (SELECT qid, sum(({g}) / log2(i + 1)) AS sdcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rk) AS i FROM jd WHERE grade IS NOT NULL) WHERE i <= 10 GROUP BY qid),
  gt AS (SELECT qid, sum(coalesce({g}, 0) / log2(rk + 1)) AS dcg, count(*) FILTER (grade >= {least}) AS hits, min(CASE WHEN grade >= {least} THEN rk END) AS fst,
    count(grade) AS n_judged, count(*) AS n_back FROM jd WHERE rk <= 10 GROUP BY qid),
  pq AS (SELECT idl.qid, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg, CASE WHEN n_rel > 0 THEN coalesce(hits, 0) / n_rel ELSE 0 END AS recall,
    coalesce(1.0::DOUBLE / fst, 0) AS mrr, CASE WHEN coalesce(n_back, 0) > 0 THEN n_judged / n_back ELSE 0 END AS judged,
    CASE WHEN ideal > 0 THEN coalesce(sdcg, 0) / ideal ELSE 0 END AS condensed
    FROM idl LEFT JOIN gt USING (qid) LEFT JOIN sh USING (qid) WHERE top >= 1)"""


_M = _MICRO.format
_POISSON = " + ".join(f"CASE WHEN u >= {b!r}::DOUBLE THEN 1 ELSE 0 END" for b in dec.POISSON_BOUNDS)
_A, _B = _metrics_sql("rank"), _metrics_sql("dense_rank")
_B = re.sub(r"\b(jd|idl|sh|gt|pq)\b", r"\1_b", _B)
_COMPARE = f"""WITH {_POOL}, {_A}, {_B},
  dd AS (SELECT metric, qid, CAST(floor(d * 1e6 + 0.5) AS BIGINT) AS micro FROM (
    SELECT 'ndcg' AS metric, a.qid, a.ndcg - b.ndcg AS d FROM pq a JOIN pq_b b USING (qid) UNION ALL
    SELECT 'recall', a.qid, a.recall - b.recall FROM pq a JOIN pq_b b USING (qid) UNION ALL
    SELECT 'mrr', a.qid, a.mrr - b.mrr FROM pq a JOIN pq_b b USING (qid))),
  rp AS (SELECT dd.*, r, CAST('0x' || substr(sha256('42:' || r || ':' || qid), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM dd, range(1, 1001) t(r)),
  fl AS (SELECT metric, r, abs(sum(CASE WHEN u < 0.5 THEN micro ELSE -micro END)) AS s FROM rp GROUP BY ALL),
  ob AS (SELECT metric, abs(sum(micro)) AS s0, count(*) AS n, sum(micro) / count(*) / 1e6::DOUBLE AS delta FROM dd GROUP BY metric),
  pv AS (SELECT ob.metric, any_value(n) AS n, any_value(delta) AS delta, (count(*) FILTER (s >= s0) + 1) / 1001 AS p FROM ob JOIN fl USING (metric) GROUP BY ob.metric),
  mn AS (SELECT metric, r, sum(w * micro) / sum(w) / 1e6::DOUBLE AS m FROM (SELECT metric, r, micro, {_POISSON} AS w FROM rp) GROUP BY ALL HAVING sum(w) > 0),
  ci AS (SELECT metric, list_sort(list(m)) AS ms FROM mn GROUP BY metric),
  hm AS (SELECT *, max(p * (3 - i)) OVER (PARTITION BY metric = 'ndcg' ORDER BY i) AS holm FROM (
    SELECT *, row_number() OVER (PARTITION BY metric = 'ndcg' ORDER BY p, metric) AS i FROM pv)),
  cp AS (SELECT metric, n, {_M('delta')} AS delta, {_M('ms[CAST(floor(len(ms) * 0.025) AS BIGINT) + 1]')} AS low,
    {_M('ms[least(len(ms) - 1, CAST(floor(len(ms) * 0.975) AS BIGINT)) + 1]')} AS high,
    {_M("CASE WHEN metric = 'ndcg' THEN p ELSE least(1.0, holm) END")} AS p, CASE WHEN metric = 'mrr' THEN false ELSE delta < -0.05 END AS fails_gate
    FROM hm JOIN ci USING (metric))"""
SQL |= {
    "ndcg_at_k": f"""WITH {_POOL}, {_A}, s AS (WITH {_metrics_sql('rank', 2)} SELECT qid, ndcg FROM pq)
        SELECT pq.qid, {_M('pq.ndcg')} AS ndcg_micro, {_M('s.ndcg')} AS strict_micro FROM pq JOIN s ON s.qid = pq.qid""",
    "recall_mrr_judged": f"WITH {_POOL}, {_A} SELECT qid, {_M('recall')} AS recall_micro, {_M('mrr')} AS mrr_micro, {_M('judged')} AS judged_micro FROM pq",
    "condensed_ndcg": f"WITH {_POOL}, {_A} SELECT qid, {_M('condensed')} AS condensed_micro FROM pq",
    "facet_means": f"""WITH {_POOL}, {_A} SELECT e.label AS facet, count(*) AS n_q, CAST(floor(sum({_M('ndcg')}) / count(*)) AS BIGINT) AS mean_micro
        FROM pq JOIN embeddings e ON e.vec_id = pq.qid GROUP BY e.label""",
    "run_comparison": f"{_COMPARE} SELECT * FROM cp",
    "run_verdict": f"""{_COMPARE}, one AS (SELECT qid, sha256(string_agg(qid || chr(9) || did || chr(9) || grade, chr(10) ORDER BY qid || chr(9) || did || chr(9) || grade)) AS h
          FROM pool WHERE grade IS NOT NULL GROUP BY qid),
        lab AS (SELECT sha256(sha256(string_agg(qid || chr(9) || h, chr(10) ORDER BY qid || chr(9) || h))) AS labels_sha FROM one)
        SELECT CASE WHEN (SELECT avg(judged) FROM pq) < 0.9 THEN 'inconclusive' WHEN (SELECT bool_or(fails_gate) FROM cp) THEN 'fail' ELSE 'pass' END AS status, labels_sha FROM lab""",
}

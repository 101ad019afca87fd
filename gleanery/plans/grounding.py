"""Queries on quotes and their grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import FILLERS, n_words
from gleanery.operators import quotes as q
from gleanery.session import table


def _grounded(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "items").where("evidence IS NOT NULL AND text IS NOT NULL").select("item_id", "evidence", "text").distinct()
    return q.ground_quotes(items, "item_id", "evidence", "text")


def quote_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Score in thousandths, place and acceptance of each
    item's evidence in its own text."""
    return _grounded(spark, sf).select("item_id", F.floor(F.col("score") * 1000).cast("long").alias("score_milli"), "at", "ok")


def quote_in_document(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the items sought in the whole text of their document."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body"))
    items = table(spark, sf, "items").where("evidence IS NOT NULL").select("item_id", "doc_id", "evidence").distinct()
    found = q.ground_quotes(items.join(docs, "doc_id"), "item_id", "evidence", "body")
    return found.groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("score") * 1000)).cast("long").alias("score_sum"))


def verified_items(spark: SparkSession, sf: str) -> DataFrame:
    """items with a quote whose score, kept to three digits, reaches the threshold."""
    score = F.floor(F.col("score") * 1000 + 0.5)
    return _grounded(spark, sf).select("item_id", (score >= 1000 * q.MIN_JACCARD).alias("verified"))


def verification_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the share of their items' quotes found, long documents
    without items or advice flagged."""
    items = table(spark, sf, "items").where("doc_id NOT IN ('', '-1')").select("item_id", "doc_id", "kind", "evidence", "text").distinct()
    asserted = items.where("kind IN ('advice', 'takeaway', 'fact') AND coalesce(evidence, '') <> '' AND text IS NOT NULL")
    scored = asserted.select("item_id", "doc_id").join(q.ground_quotes(asserted, "item_id", "evidence", "text"), "item_id")
    counts = items.groupBy("doc_id").agg(
        F.count_if(F.col("kind").isin("advice", "takeaway", "fact")).alias("n_items"), F.count_if(F.col("kind") == "advice").alias("n_advice")
    )
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), n_words(F.col("text")).alias("n_words"), F.col("doc_type").alias("category")
    )
    known = docs.join(counts, "doc_id", "left").fillna(0, ["n_items", "n_advice"])
    issue = q.record_issue(F.col("n_words"), F.col("n_items"), F.col("n_advice"), F.col("category"), F.lit(False)).isNotNull()
    rows = known.withColumn("problem", issue).select("doc_id", "problem").join(scored.select("doc_id", "ok"), "doc_id", "left")
    return q.roll_up(rows, "doc_id", F.col("problem")).select(
        "doc_id", "checked", "failed", F.floor(F.col("pass_rate") * 1000).cast("long").alias("pass_milli"), "status"
    )


def acceptance_report(spark: SparkSession, sf: str) -> DataFrame:
    """Records and quotes per status, with their mean pass rate."""
    return verification_status(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("checked").alias("n_quotes"), F.sum("failed").alias("n_failed"),
        F.floor(F.avg("pass_milli")).cast("long").alias("mean_pass_milli"),
    )


QUERIES = {f.__name__: f for f in (quote_grounding, quote_in_document, verified_items, verification_status, acceptance_report)}

_FILL = ", ".join(f"'{w}'" for w in FILLERS)


def _norm(c: str) -> str:
    notes = r"\[[^\]]{0,40}\]|\(\s*[^()\s]+(\s+[^()\s]+){0,2}\s*\)"
    return (
        f"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({c}), '{notes}', ' ', 'g'), "
        f"'[^a-z0-9'' ]+', ' ', 'g'), ' +'), lambda w: w <> '' AND w NOT IN ({_FILL}))"
    )


def _ground(source: str) -> str:
    """The rule spelled out window by window over rows (item_id, evidence, body)."""
    return rf"""src AS ({source}),
pieces AS (
  SELECT item_id, i, p, t FROM (
    SELECT item_id, i, {_norm('piece')} AS p, t FROM (
      SELECT item_id, {_norm('body')} AS t, unnest(string_split_regex(evidence, '\[\s*\.\.\.\s*\]|\.{{3,}}|…')) AS piece,
        unnest(range(0, len(string_split_regex(evidence, '\[\s*\.\.\.\s*\]|\.{{3,}}|…')))) AS i FROM src)) WHERE len(p) >= 4
), whole AS (
  SELECT item_id, 0 AS i, {_norm('evidence')} AS p, {_norm('body')} AS t FROM src WHERE item_id NOT IN (SELECT item_id FROM pieces)
), pc AS (SELECT * FROM pieces UNION ALL SELECT * FROM whole WHERE len(p) > 0),
jac AS (
  SELECT item_id, i, s, len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p))) AS score FROM (
    SELECT item_id, i, p, s, t[s + 1:s + greatest(len(p), 4)] AS w FROM (
      SELECT *, unnest(range(0, greatest(1, len(t) - greatest(len(p), 4) + 1))) AS s FROM pc WHERE len(t) > 0))
), bj AS (SELECT item_id, i, max(score) AS score, arg_max(s, (score, -s)) AS s FROM jac GROUP BY ALL),
con AS (
  SELECT item_id, i, k, s, len(list_intersect(t[s + 1:s + size], p)) / len(list_distinct(p)) AS score FROM (
    SELECT *, unnest(range(0, greatest(1, len(t) - size + 1))) AS s FROM (
      SELECT pc.*, k, CAST(round_even(len(p) * k, 0) AS BIGINT) AS size FROM pc, (VALUES (1.15::DOUBLE), (1.3::DOUBLE), (1.5::DOUBLE)) ks(k)
      WHERE len(t) > 0 AND len(list_distinct(p)) >= 8 AND (item_id, i) IN (SELECT (item_id, i) FROM bj WHERE score < 0.7)))
), bc AS (SELECT item_id, i, max(score) AS score, arg_max(s, (score, -k, -s)) AS s FROM con GROUP BY ALL),
m AS (
  SELECT pc.item_id, pc.i, CASE WHEN bj.score < 0.7 AND bc.score >= 0.9 THEN bc.score ELSE coalesce(bj.score, 0) END AS score,
    CASE WHEN bj.score < 0.7 AND bc.score >= 0.9 THEN bc.s WHEN bj.score > 0 THEN bj.s END AS s,
    coalesce(bj.score >= 0.7, false) OR coalesce(bc.score >= 0.9, false) AS ok
  FROM pc LEFT JOIN bj USING (item_id, i) LEFT JOIN bc USING (item_id, i)
), ground AS (
  SELECT src.item_id, coalesce(min(m.score), 0) AS score, arg_min(m.s, m.i) AS "at", coalesce(bool_and(m.ok), false) AS ok
  FROM (SELECT DISTINCT item_id FROM src) src LEFT JOIN m USING (item_id) GROUP BY src.item_id
)"""


_OWN = _ground("SELECT DISTINCT item_id, evidence, text AS body FROM items WHERE evidence IS NOT NULL AND text IS NOT NULL")
_IN_DOCUMENT = _ground("""SELECT DISTINCT item_id, evidence, d.text AS body FROM items i JOIN documents d ON i.doc_id = CAST(d.doc_id AS VARCHAR)
    WHERE evidence IS NOT NULL AND d.text IS NOT NULL""")
_STATUS = rf"""WITH it AS (SELECT DISTINCT item_id, doc_id, kind, evidence, text FROM items WHERE doc_id NOT IN ('', '-1')),
{_OWN}, used AS (SELECT it.doc_id, g.ok FROM it JOIN ground g USING (item_id) WHERE kind IN ('advice', 'takeaway', 'fact') AND coalesce(evidence, '') <> '' AND text IS NOT NULL),
per AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (NOT ok) AS failed FROM used GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) FILTER (kind IN ('advice', 'takeaway', 'fact')) AS n_items, count(*) FILTER (kind = 'advice') AS n_advice FROM it GROUP BY doc_id),
d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_type, len(list_filter(string_split_regex(coalesce(text, ''), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '')) AS n FROM documents),
r AS (SELECT d.doc_id, coalesce(checked, 0) AS checked, coalesce(failed, 0) AS failed,
  CASE WHEN coalesce(checked, 0) = 0 THEN 1.0::DOUBLE ELSE (checked - failed) / checked END AS rate,
  n >= 1000 AND (coalesce(n_items, 0) = 0 OR (coalesce(n_advice, 0) = 0 AND coalesce(doc_type, '') NOT IN ('ai-and-tech-trends', 'founder-story', 'other'))) AS issue
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cnt USING (doc_id)),
st AS (SELECT doc_id, checked, failed, CAST(floor(rate * 1000) AS BIGINT) AS pass_milli,
  CASE WHEN rate < 0.6 THEN 'failed' WHEN rate < 0.9 OR issue THEN 'flagged' ELSE 'pass' END AS status FROM r)"""
SQL = {
    "quote_grounding": f"WITH {_OWN} SELECT item_id, CAST(floor(score * 1000) AS BIGINT) AS score_milli, \"at\", ok FROM ground",
    "quote_in_document": f"WITH {_IN_DOCUMENT} SELECT ok, count(*) AS n, CAST(sum(floor(score * 1000)) AS BIGINT) AS score_sum FROM ground GROUP BY ok",
    "verified_items": f"WITH {_OWN} SELECT item_id, floor(score * 1000 + 0.5) >= 700 AS verified FROM ground",
    "verification_status": f"{_STATUS} SELECT * FROM st",
    "acceptance_report": f"""{_STATUS} SELECT status, count(*) AS n_docs, CAST(sum(checked) AS BIGINT) AS n_quotes, CAST(sum(failed) AS BIGINT) AS n_failed,
        CAST(floor(avg(pass_milli)) AS BIGINT) AS mean_pass_milli FROM st GROUP BY status""",
}

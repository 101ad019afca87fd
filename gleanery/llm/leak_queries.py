"""Queries on evaluation texts in the corpus (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.eval_leaks import leaks
from gleanery.session import table


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of an item word by word."""
    return _leaks(spark, sf).where(F.col("distance") == 0).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item: documents with a passage, exact or with one error."""
    return (
        _leaks(spark, sf)
        .groupBy("item_id")
        .agg(
            F.count_if(F.col("distance") == 0).alias("n_exact"),
            F.count_if(F.col("distance") > 0).alias("n_near"),
        )
    )


_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM eval_items WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM dw WHERE len(w) >= 12
), its AS (
  SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM iw WHERE len(w) >= 12
)
SELECT DISTINCT doc_id, item_id FROM ds JOIN its USING (s)
"""

#: One wrong word: replaced (equal but for one place), missing (11 words are the
#: passage less one) or added (13 words less one are the passage).
_NEAR_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM eval_items WHERE text IS NOT NULL
), passage AS (
  SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: w[i:i + 11])) AS p FROM iw WHERE len(w) >= 12
), cut AS (
  SELECT DISTINCT item_id, i, array_to_string(p[1:i - 1], ' ') || '|' || array_to_string(p[i + 1:12], ' ') AS s,
    array_to_string(list_concat(p[1:i - 1], p[i + 1:12]), ' ') AS less FROM passage, range(1, 13) r(i)
), whole AS (
  SELECT DISTINCT item_id, array_to_string(p, ' ') AS s FROM passage
), piece AS (  -- six words in a row that a leak must keep
  SELECT DISTINCT array_to_string(w[i:i + 5], ' ') AS s FROM iw, range(1, 400) r(i) WHERE i + 5 <= len(w)
), spot AS (
  SELECT DISTINCT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM dw WHERE len(w) >= 6)
  WHERE array_to_string(w[i:i + 5], ' ') IN (SELECT s FROM piece)
), start AS (
  SELECT DISTINCT doc_id, w, i - o AS a FROM spot, range(0, 8) r(o) WHERE i - o >= 1
), w12 AS (SELECT doc_id, w[a:a + 11] AS p FROM start WHERE a + 11 <= len(w)),
w11 AS (SELECT doc_id, w[a:a + 10] AS p FROM start WHERE a + 10 <= len(w)),
w13 AS (SELECT doc_id, w[a:a + 12] AS p FROM start WHERE a + 12 <= len(w)),
hit AS (
  SELECT doc_id, item_id, 0 AS d FROM w12 JOIN whole ON s = array_to_string(p, ' ')
  UNION ALL SELECT doc_id, item_id, 1 FROM (SELECT doc_id, j, array_to_string(p[1:j - 1], ' ') || '|' || array_to_string(p[j + 1:12], ' ') AS s
      FROM w12, range(1, 13) r(j)) x JOIN cut ON cut.s = x.s AND cut.i = x.j
  UNION ALL SELECT doc_id, item_id, 1 FROM w11 JOIN (SELECT DISTINCT item_id, less FROM cut) c ON less = array_to_string(p, ' ')
  UNION ALL SELECT doc_id, item_id, 1 FROM (SELECT doc_id, array_to_string(list_concat(p[1:j - 1], p[j + 1:13]), ' ') AS s
      FROM w13, range(1, 14) r(j)) x JOIN whole ON whole.s = x.s
), best AS (SELECT doc_id, item_id, min(d) AS d FROM hit GROUP BY ALL)
SELECT item_id, CAST(count(*) FILTER (d = 0) AS BIGINT) AS n_exact, CAST(count(*) FILTER (d > 0) AS BIGINT) AS n_near FROM best GROUP BY ALL
"""

QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL = {"p9_found": _SQL, "p9_items": _NEAR_SQL}

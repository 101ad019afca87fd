"""Queries on near-duplicate records (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import near_duplicates as nd
from gleanery.session import table


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records that are edited copies of one another."""
    items = nd.similar_records(table(spark, sf, "items"), "items", "item_id", "indexable")
    titles = nd.similar_records(table(spark, sf, "documents"), "documents", "doc_id", "title")
    videos = nd.one_edit_apart(table(spark, sf, "web_videos"), "web_videos", "video_id")
    return items.unionByName(titles).unionByName(videos)


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Group and number of links of every record that has a copy."""
    return nd.connected_groups(p7_found(spark, sf))


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
#: All pairs of the records' word sets, and of the ids; edits by trying each kind.
_FOUND = r"""
WITH r AS (
  SELECT DISTINCT 'items' AS t, item_id AS k, list_sort(list_distinct(regexp_extract_all(lower(indexable), '[a-z0-9'']+'))) AS w FROM items WHERE item_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'documents', CAST(doc_id AS VARCHAR), list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9'']+'))) FROM documents
), s AS MATERIALIZED (SELECT t, k, w, len(w) AS n FROM r WHERE len(w) > 0),
sets AS (
  SELECT a.t, a.k AS ka, b.k AS kb, len(list_intersect(a.w, b.w)) AS both_, a.n + b.n AS n
  FROM s a JOIN s b ON a.t = b.t AND a.k < b.k AND b.n * 5 >= a.n * 4 AND a.n * 5 >= b.n * 4
), v AS MATERIALIZED (SELECT DISTINCT video_id AS k FROM web_videos WHERE video_id <> ''),
cut AS MATERIALIZED (SELECT k, unnest(list_distinct(list_append(list_transform(range(1, length(k) + 1), lambda i: substr(k, 1, i - 1) || substr(k, i + 1)), k))) AS c FROM v),
ids AS (SELECT DISTINCT a.k AS p, b.k AS q FROM cut a JOIN cut b ON a.c = b.c AND a.k < b.k)
SELECT DISTINCT t AS rec_table, ka AS key_a, kb AS key_b FROM sets WHERE both_ * 5 >= (n - both_) * 4
UNION ALL SELECT 'web_videos', p, q FROM ids WHERE levenshtein(p, q) = 1
  OR (length(p) = length(q) AND len(list_filter(range(1, length(p)), lambda i: substr(p, 1, i - 1) || substr(p, i + 1, 1) || substr(p, i, 1) || substr(p, i + 2) = q)) > 0)
"""
_GROUPS = f"""
WITH RECURSIVE f AS MATERIALIZED ({_FOUND}),
e AS (SELECT rec_table AS t, key_a AS a, key_b AS b FROM f UNION SELECT rec_table, key_b, key_a FROM f),
r(t, k, o) AS (SELECT DISTINCT t, a, a FROM e UNION SELECT r.t, r.k, e.b FROM r JOIN e ON e.t = r.t AND e.a = r.o)
SELECT r.t AS rec_table, r.k AS key, min(r.o) AS group_key, (SELECT count(*) FROM e WHERE e.t = r.t AND e.a = r.k) AS n_links FROM r GROUP BY r.t, r.k
"""
SQL = {"p7_found": _FOUND, "p7_groups": _GROUPS}

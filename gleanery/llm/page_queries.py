"""Queries over web pages (problems 3 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import main_content as mc
from gleanery.llm import repeated_lines as rl
from gleanery.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that carry text of each page's main body."""
    return mc.main_lines(table(spark, sf, "web_pages"), table(spark, sf, "web_raw"))


def p3_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Main-body lines kept per page."""
    return p3_found(spark, sf).groupBy("doc_id").count().withColumnRenamed("count", "n_lines")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a line on at least 8 pages of its source."""
    return rl.repeated_lines(table(spark, sf, "web_pages"), table(spark, sf, "web_raw")).select(
        "doc_id", "line_no"
    ).distinct()


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's text without its source's repeated lines."""
    return rl.pages_without_repeats(table(spark, sf, "web_pages"), table(spark, sf, "web_raw"))


_P6_SQL = r"""
WITH pages AS (
  SELECT DISTINCT doc_id, lower(trim(source_id, chr(9) || chr(10) || chr(13) || chr(160) || ' ')) AS source, raw_path
  FROM web_pages WHERE raw_path IS NOT NULL AND doc_id IS NOT NULL
), cut AS (
  SELECT raw_path, string_split(html, chr(10)) AS ls FROM web_raw WHERE html IS NOT NULL
), numbered AS (
  SELECT raw_path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line_no FROM cut
), seen AS (
  SELECT raw_path, CAST(line_no AS INTEGER) AS line_no,
    trim(regexp_replace(regexp_replace(lower(
      regexp_replace(regexp_replace(regexp_replace(l, '<!--.*?-->', '', 'g'),
        '(?i)<script\b[^>]*>.*?</script\s*>', '', 'g'), '<[^>]*>', '', 'g')),
      '\d+', '0', 'g'), '\s+', ' ', 'g')) AS k
  FROM numbered
), lines AS (
  SELECT p.doc_id, p.source, s.line_no, s.k FROM pages p JOIN seen s USING (raw_path)
  WHERE s.k <> '' AND p.source <> ''
), often AS (
  SELECT source, k FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) >= 8
)
SELECT DISTINCT l.doc_id, l.line_no FROM lines l JOIN often USING (source, k)
"""

_P6_CLEAN = _P6_SQL.split("SELECT DISTINCT l.doc_id, l.line_no FROM lines l JOIN often")[0].rstrip() + r"""
, gone AS (SELECT DISTINCT l.doc_id, l.line_no FROM lines l JOIN often USING (source, k)),
shown AS (
  SELECT p.doc_id, CAST(n.line_no AS INTEGER) AS line_no, trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(l, '<!--.*?-->', '', 'g'), '(?i)<script\b[^>]*>.*?</script\s*>', '', 'g'), '<[^>]*>', '', 'g'),
    '\s+', ' ', 'g')) AS v
  FROM (SELECT DISTINCT doc_id, raw_path FROM pages WHERE source <> '') p JOIN numbered n USING (raw_path)
)
SELECT s.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
  coalesce(string_agg(v, chr(10) ORDER BY s.line_no) FILTER (g.line_no IS NULL), '') AS text
FROM shown s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.line_no = s.line_no WHERE v <> '' GROUP BY s.doc_id
"""

QUERIES = {"p3_found": p3_found, "p3_summary": p3_summary, "p6_found": p6_found, "p6_clean": p6_clean}
SQL = {"p6_found": _P6_SQL, "p6_clean": _P6_CLEAN}

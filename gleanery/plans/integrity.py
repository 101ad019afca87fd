"""Queries over dangling references (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.references import (
    orphan_references,
    parent_intervals,
    reference_rows,
    union_all,
)
from gleanery.session import table


def _faults(spark: SparkSession, sf: str) -> DataFrame:
    refs = union_all(
        [
            reference_rows(
                table(spark, sf, "edges"), "edges", "edge_id", "ingested_at",
                {"src": "nodes", "dst": "nodes"},
            ),
            reference_rows(
                table(spark, sf, "commitments"), "commitments", "id", "created_at",
                {"goal_id": "goals"},
            ),
            reference_rows(
                table(spark, sf, "positions"), "positions", "pos_id", "loaded_at",
                {"snapshot_id": "holdings_snapshots"},
            ),
        ]
    )
    parents = union_all(
        [
            parent_intervals(table(spark, sf, "nodes"), "nodes", "node_id", "created_at", "purged_at"),
            parent_intervals(table(spark, sf, "goals"), "goals", "id", "created_at", "deleted_at"),
            parent_intervals(
                table(spark, sf, "holdings_snapshots"), "holdings_snapshots", "id",
                "imported_at", "deleted_at",
            ),
        ]
    )
    return orphan_references(refs, parents)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference whose record is absent, deleted or younger."""
    return _faults(spark, sf).select("src_table", "src_field", "row_key", "period").distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans counted per referring table, field, month and kind of fault."""
    return (
        _faults(spark, sf)
        .groupBy("src_table", "src_field", "period", "fault")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )


_TRIM = r"lower(regexp_replace({0}, '^[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g'))"


def _t(c: str) -> str:
    return _TRIM.format(c)


_FAULTS_SQL = f"""
WITH refs AS (
  SELECT 'edges' AS src_table, 'src' AS src_field, edge_id AS row_key, ingested_at AS ref_at,
         'nodes' AS target, {_t('src')} AS k FROM edges
  UNION ALL SELECT 'edges', 'dst', edge_id, ingested_at, 'nodes', {_t('dst')} FROM edges
  UNION ALL SELECT 'commitments', 'goal_id', id, created_at, 'goals', {_t('goal_id')} FROM commitments
  UNION ALL SELECT 'positions', 'snapshot_id', CAST(pos_id AS VARCHAR), loaded_at,
         'holdings_snapshots', {_t('snapshot_id')} FROM positions
), rows AS (
  SELECT 'nodes' AS target, {_t('node_id')} AS k, created_at AS made, purged_at AS gone FROM nodes
  UNION ALL SELECT 'goals', {_t('id')}, created_at, deleted_at FROM goals
  UNION ALL SELECT 'holdings_snapshots', {_t('id')}, imported_at, deleted_at FROM holdings_snapshots
), faults AS (
  SELECT DISTINCT r.src_table, r.src_field, r.row_key,
    coalesce(strftime(r.ref_at AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period,
    CASE WHEN NOT EXISTS (SELECT 1 FROM rows p WHERE p.target = r.target AND p.k = r.k) THEN 'missing'
         WHEN NOT EXISTS (SELECT 1 FROM rows p WHERE p.target = r.target AND p.k = r.k AND p.gone IS NULL)
           THEN 'deleted'
         WHEN NOT EXISTS (SELECT 1 FROM rows p WHERE p.target = r.target AND p.k = r.k
                          AND (p.made IS NULL OR p.made <= r.ref_at)) AND r.ref_at IS NOT NULL
           THEN 'late' END AS fault
  FROM refs r WHERE r.k <> ''
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _FAULTS_SQL
    + "SELECT DISTINCT src_table, src_field, row_key, period FROM faults WHERE fault IS NOT NULL",
    "p1_report": _FAULTS_SQL
    + """SELECT src_table, src_field, period, fault, CAST(count(*) AS BIGINT) AS n_refs
         FROM faults WHERE fault IS NOT NULL GROUP BY ALL""",
}

"""Plans on the knowledge graph (nodes, edges)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.graph import bounded_walk, components
from gleanery.operators.references import id_key
from gleanery.plans.dialect import plans
from gleanery.session import table

_LIVE = """
 n AS (SELECT DISTINCT [[tidy:node_id]] AS id, node_type FROM {nodes} WHERE purged_at IS NULL),
 e AS (SELECT DISTINCT edge_id, [[tidy:src]] AS src, [[tidy:dst]] AS dst, relation, tier, confidence, source_doc, invalid_at FROM {edges}
       WHERE src IS NOT NULL AND dst IS NOT NULL)
"""
TEXTS = {
    "graph_stats": f"""-- A4: live and superseded edges by relation
        WITH {_LIVE} SELECT relation, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN invalid_at IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_superseded FROM e GROUP BY relation""",
    "node_counts": f"""-- A4: live nodes by type
        WITH {_LIVE} SELECT node_type, CAST(count(DISTINCT id) AS BIGINT) AS n FROM n GROUP BY node_type""",
    "edge_to_node": f"""-- J3: live edges per type of the node they reach
        WITH {_LIVE} SELECT n.node_type, e.relation, CAST(count(*) AS BIGINT) AS n FROM e JOIN n ON e.dst = n.id WHERE e.invalid_at IS NULL GROUP BY n.node_type, e.relation""",
    "contradictions": f"""-- G3: contradictions at either end
        WITH {_LIVE} SELECT edge_id, src, dst FROM e WHERE relation = 'contradicts' AND src <> '' AND dst <> ''""",
    "advice_for_stage": f"""-- G4 Q16: live atoms of each stage in id order, ten a stage
        WITH {_LIVE} SELECT dst, src, CAST(rn AS BIGINT) AS rn FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src, edge_id) AS rn
          FROM e WHERE dst LIKE 'stage:%' AND src LIKE 'atom:%' AND invalid_at IS NULL) x WHERE rn <= 10""",
    "invalidate_edges": f"""-- G5: live edges of an older document invalidated by a newer one of the same pair
        WITH {_LIVE}, r AS (SELECT edge_id, src, dst, relation, row_number() OVER (PARTITION BY src, dst, relation ORDER BY source_doc DESC NULLS LAST, edge_id) AS rn FROM e WHERE invalid_at IS NULL)
        SELECT edge_id, rn > 1 AS now_invalid FROM r""",
    "purge_document": """-- G6: edges left after purging every document whose id is divisible by 100
        SELECT relation, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT edge_id, relation, source_doc FROM {edges}) e
        WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id % 100 = 0 AND CAST(d.doc_id AS VARCHAR(20)) = e.source_doc) GROUP BY relation""",
    "export_live_graph": f"""-- G7: live edge list with its weight in thousandths
        WITH {_LIVE} SELECT edge_id, src, dst, CAST(floor(confidence * 1000 + 0.5) AS BIGINT) AS weight_milli FROM e WHERE invalid_at IS NULL""",
    "graph_as_of": """-- Q2 G2: edges valid at an instant, both clocks
        SELECT relation, CAST(count(DISTINCT edge_id) AS BIGINT) AS n FROM {edges}
        WHERE (valid_from IS NULL OR [[epoch:valid_from]] <= 1672531200) AND (invalid_at IS NULL OR [[epoch:invalid_at]] > 1672531200)
          AND (ingested_at IS NULL OR [[epoch:ingested_at]] <= 1704067200) GROUP BY relation""",
    "graph_project": """-- G1 Q1 Q4: items as atom nodes with their series, stage and topic edges
        WITH i AS (SELECT DISTINCT item_id, doc_id, series, kind FROM {items}),
        s AS (SELECT DISTINCT item_id, [[rows:stages]] AS stage FROM {items}), t AS (SELECT DISTINCT item_id, [[rows:topics]] AS topic FROM {items})
        SELECT relation, CAST(count(*) AS BIGINT) AS n_edges, CAST(count(DISTINCT dst) AS BIGINT) AS n_targets FROM (
          SELECT item_id AS src, 'has_atom' AS relation, doc_id AS dst FROM i WHERE doc_id NOT IN ('', '-1')
          UNION ALL SELECT item_id, 'in_series', series FROM i WHERE series IS NOT NULL AND series <> ''
          UNION ALL SELECT item_id, 'applies_to', stage FROM s UNION ALL SELECT item_id, 'about', topic FROM t) x GROUP BY relation""",
    "alias_resolution": """-- J19 X27: labels resolved by their normal form to the first node of it
        WITH k AS (SELECT DISTINCT [[tidy:node_id]] AS id, trim([[replace:[[replace:lower(label)¦'[.]'¦'']]¦'[ ]+'¦' ']]) AS name FROM {nodes} WHERE label IS NOT NULL AND purged_at IS NULL),
        f AS (SELECT name, min(id) AS owner FROM k GROUP BY name)
        SELECT k.id, f.owner FROM k JOIN f ON k.name = f.name WHERE k.id <> f.owner""",
}
QUERIES, SQL = plans(TEXTS)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "edges").where("invalid_at IS NULL")
        .select(id_key(F.col("src")).alias("src"), id_key(F.col("dst")).alias("dst"), "relation")
        .where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    )


def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges within two hops of every stage node, per hop."""
    edges = _edges(spark, sf)
    start = edges.where("dst LIKE 'stage:%'").select(F.col("dst").alias("node")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return bounded_walk(back, start, 2).groupBy("hop", "relation").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the contradiction graph."""
    edges = _edges(spark, sf).where("relation = 'contradicts' AND src <> dst")
    return components(edges.select("src", "dst"))


QUERIES |= {"graph_bfs": graph_bfs, "graph_components": graph_components}
SQL["graph_bfs"] = """
    WITH e AS (SELECT DISTINCT lower(trim(dst, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS src, lower(trim(src, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS dst, relation FROM edges
               WHERE invalid_at IS NULL AND trim(src) <> '' AND trim(dst) <> ''),
    h1 AS (SELECT DISTINCT e.* FROM e WHERE src LIKE 'stage:%'),
    f1 AS (SELECT DISTINCT dst FROM h1 WHERE dst NOT LIKE 'stage:%' OR dst NOT IN (SELECT src FROM h1)),
    h2 AS (SELECT DISTINCT e.* FROM e WHERE src IN (SELECT dst FROM f1))
    SELECT hop, relation, CAST(count(*) AS BIGINT) AS n_edges FROM (
      SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2) GROUP BY ALL"""
SQL["graph_components"] = """
    WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(src, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS a, lower(trim(dst, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS b
      FROM edges WHERE invalid_at IS NULL AND relation = 'contradicts' AND trim(src) <> '' AND trim(dst) <> ''),
    s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
    r(node, reached) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reached)
    SELECT node, min(reached) AS component FROM r GROUP BY node"""

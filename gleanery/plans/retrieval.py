"""Queries on retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.text import STOPWORDS
from gleanery.operators import retrieval as r
from gleanery.session import table

DOC_BASE = 10_000_000_000
THIS_YEAR = 2025


def _queries(spark, sf) -> DataFrame:
    """The query set: titled documents whose id is divisible by 100."""
    return table(spark, sf, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL").select(
        (F.col("doc_id") - DOC_BASE).alias("qid"), "title"
    )


def _dense(spark, sf, k=r.CANDIDATES, group=None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return r.dense_top_k(e, "vec_id", "embedding", q, "qid", k, exclude_self=True, group=group)


def _lexical(spark, sf, only: DataFrame | None = None) -> r.LexicalIndex:
    docs = table(spark, sf, "documents").select((F.col("doc_id") - DOC_BASE).alias("vec_id"), "text")
    queries = _queries(spark, sf)
    if only is not None:
        queries = queries.join(only, "qid", "left_semi")
    return r.lexical_index(docs, "vec_id", "text", queries, "qid", "title")


def _sparse(spark, sf, k=r.CANDIDATES, only: DataFrame | None = None) -> DataFrame:
    return r.bm25_top_k(_lexical(spark, sf, only), "qid", "vec_id", k)


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine top 10 of the query vectors."""
    return _dense(spark, sf, 10).select("qid", "vec_id", "rank")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical top 10 of the query titles."""
    return _sparse(spark, sf, 10).select("qid", "vec_id", "score", "rank")


def _fused(spark, sf, only: DataFrame | None = None) -> DataFrame:
    """The fused lists, with ``only`` (qid) those of its questions: a question's list
    does not depend on the others."""
    fused = r.rrf([(_dense(spark, sf), 1.0, "dense_rank"), (_sparse(spark, sf, only=only), 1.0, "sparse_rank")], "qid", "vec_id")
    return r.fused_top(fused, "qid", "vec_id", ["dense_rank", "sparse_rank"], r.CANDIDATES)


def hybrid_search_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and lexical lists fused by reciprocal rank."""
    return _fused(spark, sf).select("qid", "vec_id", "rank", "dense_rank", "sparse_rank")


def hard_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F1 F2: item filter over kind, topic and domain."""
    return (
        table(spark, sf, "items").distinct()
        .where(r.hard_filter(["advice", "rule", "takeaway"], topics=["pricing", "hiring"], domains=["startup"]))
        .select("item_id", "kind", "doc_id")
    )


def _boosted(spark, sf) -> DataFrame:
    items = table(spark, sf, "items").where("item_id IS NOT NULL").distinct()
    docs = items.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.array_contains("stages", "seed"), F.lit(False))).alias("doc_seed"))
    return items.join(docs, "doc_id").withColumn(
        "boost",
        r.boost(
            F.col("kind"), F.coalesce(F.array_contains("stages", "seed"), F.lit(False)), F.col("doc_seed"),
            F.coalesce("year", F.lit(0)), THIS_YEAR,
        ),
    )


def boosted_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The three best boosted items of each document, in millionths."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("micro"), "item_id")
    return (
        _boosted(spark, sf).withColumn("micro", F.floor(F.col("boost") * 1e6 + 0.5).cast("long"))
        .withColumn("rank", F.row_number().over(order)).where("rank <= 3")
        .select("doc_id", "item_id", "micro", "rank")
    )


def _ranked_items(spark, sf) -> DataFrame:
    """Per document the items in order of their start, as ranked lists."""
    order = Window.partitionBy("doc_id").orderBy(F.col("start_ms").asc_nulls_last(), "item_id")
    return (
        table(spark, sf, "items").where("doc_id IS NOT NULL AND doc_id NOT IN ('', '-1')").distinct()
        .withColumn("rank", F.row_number().over(order))
        .select("doc_id", "item_id", "rank", "series", "text", "evidence", F.concat("series", F.lit("")).alias("group_doc"))
    )


def quote_document_caps(spark: SparkSession, sf: str) -> DataFrame:
    """One row per quote, three rows per series, of ranked items."""
    ranked = _ranked_items(spark, sf).withColumn("sub", F.coalesce("series", F.lit("")))
    kept = r.quote_and_document_caps(ranked, "doc_id", "sub", "evidence", "rank")
    return kept.select("doc_id", "item_id", "rank", "doc_rank")


def diversity_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy near-duplicate and series rules."""
    return r.diversify(_ranked_items(spark, sf), "doc_id", "item_id", [r.NearDuplicate(), r.SeriesCap()], 50)


def _routed(spark, sf) -> DataFrame:
    """qid, domain: labels a question is routed to (none unless two or more)."""
    scores = _dense(spark, sf, 3, group="label").groupBy("qid", "label").agg(F.floor(F.avg("cosine") * 1e6).cast("long").alias("s"))
    best = F.max("s").over(Window.partitionBy("qid"))
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "label")
    return (
        scores.withColumn("best", best).where("s >= best - 150000").withColumn("i", F.row_number().over(order)).where("i <= 3")
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid"))).where("n >= 2").select("qid", F.col("label").alias("domain"))
    )


def _searched(spark, sf) -> DataFrame:
    """Fused, boosted and capped results: qid, vec_id, domain, relevance, micro, rank."""
    labels = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("domain"))
    routed = _routed(spark, sf)
    lexical = _lexical(spark, sf)
    own_sparse = r.bm25_top_k(lexical, "qid", "vec_id", r.CANDIDATES, labels, "domain").join(routed, ["qid", "domain"])
    own_dense = _dense(spark, sf, r.CANDIDATES, group="label").withColumnRenamed("label", "domain").join(routed, ["qid", "domain"])
    fused = r.rrf(
        [
            (_dense(spark, sf), 1.0, "dense_rank"), (r.bm25_top_k(lexical, "qid", "vec_id", r.CANDIDATES), 1.0, "sparse_rank"),
            (own_dense, r.ROUTED_WEIGHT, "own_dense"), (own_sparse, r.ROUTED_WEIGHT, "own_sparse"),
        ],
        "qid", "vec_id",
    )
    top = r.fused_top(fused, "qid", "vec_id", ["dense_rank", "sparse_rank", "own_dense", "own_sparse"], r.CANDIDATES)
    facts = table(spark, sf, "documents").select(
        (F.col("doc_id") - DOC_BASE).alias("vec_id"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.year("published_at"), F.lit(0)).alias("year"),
    )
    relevance = F.col("fused") / F.max("fused").over(Window.partitionBy("qid"))
    scored = (
        top.withColumn("relevance", relevance).join(facts, "vec_id").join(labels, "vec_id", "left")
        .withColumn("score", F.col("relevance") + r.boost(F.lit(""), F.lit(False), F.lit(False), F.col("year"), THIS_YEAR))
        .withColumn("micro", F.floor(F.col("score") * 1e6 + 0.5).cast("long"))
    )
    per_source = Window.partitionBy("qid", "source").orderBy(F.desc("micro"), "vec_id")
    order = Window.partitionBy("qid").orderBy(F.desc("micro"), "vec_id")
    return (
        scored.withColumn("n", F.row_number().over(per_source)).where(f"n <= {r.PER_DOCUMENT} OR source = ''")
        .withColumn("rank", F.row_number().over(order)).select("qid", "vec_id", "domain", "relevance", "score", "micro", "rank")
    )


def full_search(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and lexical lists of the whole collection and, at half
    weight, of the domains the question is routed to; fused, scaled to the best,
    boosted, capped per source."""
    return _searched(spark, sf).where("rank <= 10").select("qid", "vec_id", "micro", F.col("rank").alias("final_rank"))


def domain_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The full search's top eight with two results of every routed domain."""
    ranked = _searched(spark, sf).withColumn("score", F.floor(F.col("score") * 1e4 + 0.5))
    return r.per_domain_floor(ranked, _routed(spark, sf), "qid", "vec_id")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_DENSE = """
dn AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dense AS (
  SELECT qid, vec_id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS qid, x.vec_id,
      list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v))) AS cosine
    FROM dn q, dn x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id)
)"""
_SPARSE = rf"""
toks AS (SELECT doc_id - {DOC_BASE} AS vec_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
asked AS (
  SELECT DISTINCT qid, term FROM (
    SELECT doc_id - {DOC_BASE} AS qid, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+')) AS term
    FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)
  WHERE length(term) > 1 AND term NOT IN ({_STOP})
),
post AS (
  SELECT term, vec_id, dl, count(*) AS tf FROM (
    SELECT vec_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS a FROM toks),
parts AS (
  SELECT p.term, p.vec_id, CAST(floor(1e9 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
     / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))) AS BIGINT) AS part
  FROM post p JOIN df USING (term), st
),
sparse AS (
  SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT qid, vec_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
)"""
_FUSED = f"""{_DENSE}, {_SPARSE},
fused AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, vec_id) AS rank
  FROM (
    SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.vec_id, s.vec_id) AS vec_id, d.rank AS dense_rank, s.rank AS sparse_rank,
      coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS fused
    FROM (SELECT * FROM dense WHERE rank <= 50) d FULL JOIN (SELECT * FROM sparse WHERE rank <= 50) s
      ON d.qid = s.qid AND d.vec_id = s.vec_id)
)"""
_PRIOR = " ".join(f"WHEN kind = '{k}' THEN {v}::DOUBLE" for k, v in r.KIND_PRIOR.items())

QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search_rrf, dense_topk, bm25_topk, hard_filter, boosted_ranking, quote_document_caps,
        diversity_greedy, full_search, domain_floor,
    )
}
SQL = {
    "hybrid_search_rrf": f"WITH {_FUSED} SELECT qid, vec_id, rank, dense_rank, sparse_rank FROM fused WHERE rank <= 50",
    "dense_topk": f"WITH {_DENSE} SELECT qid, vec_id, rank FROM dense WHERE rank <= 10",
    "bm25_topk": f"WITH {_SPARSE} SELECT qid, vec_id, score, rank FROM sparse WHERE rank <= 10",
    "hard_filter": """
        SELECT DISTINCT item_id, kind, doc_id FROM items
        WHERE kind IN ('advice', 'rule', 'takeaway') AND list_has_any(coalesce(topics, []), ['pricing', 'hiring'])
          AND list_has_any(coalesce(domains, ['startup']), ['startup'])""",
    "boosted_ranking": f"""
        WITH i AS (SELECT DISTINCT item_id, kind, doc_id, coalesce(list_contains(stages, 'seed'), false) AS s,
                          coalesce(year, 0) AS year FROM items WHERE item_id IS NOT NULL),
        d AS (SELECT doc_id, bool_or(s) AS ds FROM i GROUP BY doc_id),
        b AS (SELECT i.doc_id, item_id, CAST(floor((CASE {_PRIOR} ELSE 0.0::DOUBLE END
            + CASE WHEN s THEN 0.10::DOUBLE WHEN ds THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END
            + CASE WHEN year > 0 THEN 0.03::DOUBLE * pow(0.5::DOUBLE, greatest(0, {THIS_YEAR} - year)::DOUBLE / 5) ELSE 0 END) * 1e6 + 0.5) AS BIGINT) AS micro
          FROM i JOIN d ON i.doc_id = d.doc_id)
        SELECT doc_id, item_id, micro, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY micro DESC, item_id) AS rank FROM b) WHERE rank <= 3""",
    "quote_document_caps": """
        WITH i AS (SELECT DISTINCT doc_id, item_id, start_ms, series, evidence, text FROM items
                   WHERE doc_id IS NOT NULL AND doc_id NOT IN ('', '-1')),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms ASC NULLS LAST, item_id) AS rank,
                coalesce(series, '') AS sub,
                regexp_replace(lower(trim(coalesce(evidence, ''))), '\\s+', ' ', 'g') AS q FROM i),
        a AS (SELECT *, CASE WHEN q = '' THEN 1 ELSE row_number() OVER (PARTITION BY doc_id, sub, q ORDER BY rank) END AS qr FROM k),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sub ORDER BY rank) AS doc_rank FROM a WHERE qr = 1)
        SELECT doc_id, item_id, rank, doc_rank FROM b WHERE doc_rank <= 3""",
    "full_search": f"""
        WITH {_FUSED},
        ds AS (SELECT qid, label, CAST(floor(avg(cosine) * 1e6) AS BIGINT) AS s FROM (
          SELECT d.qid, e.label, d.cosine, row_number() OVER (PARTITION BY d.qid, e.label ORDER BY d.cosine DESC, d.vec_id) AS n FROM dense d JOIN embeddings e USING (vec_id)) WHERE n <= 3 GROUP BY ALL),
        rt AS (SELECT qid, label FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS i FROM (SELECT *, max(s) OVER (PARTITION BY qid) AS best FROM ds) WHERE s >= best - 150000) WHERE i <= 3) WHERE n >= 2),
        od AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid, label ORDER BY cosine DESC, vec_id) AS rank FROM dense d JOIN embeddings e USING (vec_id) JOIN rt USING (qid, label)),
        os AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS rank FROM sparse s JOIN embeddings e USING (vec_id) JOIN rt USING (qid, label)),
        ls AS (SELECT qid, vec_id, rank, 1 AS k FROM dense WHERE rank <= 50 UNION ALL SELECT qid, vec_id, rank, 2 FROM sparse WHERE rank <= 50
          UNION ALL SELECT qid, vec_id, rank, 3 FROM od WHERE rank <= 50 UNION ALL SELECT qid, vec_id, rank, 4 FROM os WHERE rank <= 50),
        pv AS (SELECT qid, vec_id, max(rank) FILTER (k = 1) AS a, max(rank) FILTER (k = 2) AS b, max(rank) FILTER (k = 3) AS c, max(rank) FILTER (k = 4) AS d FROM ls GROUP BY ALL),
        fu AS (SELECT *, ((coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0)) + coalesce(0.5::DOUBLE / (60 + c), 0)) + coalesce(0.5::DOUBLE / (60 + d), 0) AS f FROM pv),
        fk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, a NULLS LAST, b NULLS LAST, c NULLS LAST, d NULLS LAST, vec_id) AS i, max(f) OVER (PARTITION BY qid) AS best FROM fu),
        s AS (SELECT fk.qid, fk.vec_id, coalesce(d.source, '') AS source,
            CAST(floor((fk.f / fk.best
              + CASE WHEN d.published_at IS NULL THEN 0 ELSE 0.03::DOUBLE * pow(0.5::DOUBLE,
                  greatest(0, {THIS_YEAR} - year(d.published_at AT TIME ZONE 'UTC'))::DOUBLE / 5) END) * 1e6 + 0.5) AS BIGINT) AS micro
          FROM fk JOIN documents d ON d.doc_id = fk.vec_id + {DOC_BASE} WHERE fk.i <= 50),
        c AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY micro DESC, vec_id) AS n FROM s)
        SELECT qid, vec_id, micro, final_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY qid ORDER BY micro DESC, vec_id) AS final_rank FROM c
          WHERE n <= 3 OR source = '') WHERE final_rank <= 10""",
}

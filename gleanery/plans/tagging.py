"""Queries on domain tagging by profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import tagging as tg
from gleanery.session import table

FLOOR, CLOSE, SHARE, MIN_PASSAGES = 0.2, 0.04, 0.3, 2


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors against the mean vector of every label; five vectors in a row are a
    document, the first its summary and hinted by its label in every third."""
    e = table(spark, sf, "embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select("label", "m.x").collect()
    )
    profiles = [(f"d{r['label']}", list(r["x"])) for r in means]
    hint = F.when(F.expr("vec_id div 5 % 3 = 0"), F.concat(F.lit("d"), F.col("label").cast("string")))
    facts = e.select("vec_id", F.expr("vec_id div 5").alias("doc"), (F.col("vec_id") % 5 != 0).alias("is_passage"), hint.alias("hint"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("own"))
    return tg.profile_scores(e, "vec_id", "embedding", profiles).join(facts, "vec_id")


def item_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of every vector, hinted ones favoured."""
    tags = tg.candidates(F.col("scores"), F.lit(FLOOR), F.lit(CLOSE), F.col("hint"), 0.05)
    return _scores(spark, sf).select("vec_id", F.array_join(tags, ",").alias("tags"))


def document_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of every document and where they come from."""
    items = _scores(spark, sf).withColumn("tags", tg.candidates(F.col("scores"), F.lit(FLOOR), F.lit(CLOSE)))
    got = tg.document_tags(items, ["doc"], F.lit(SHARE), F.lit(MIN_PASSAGES), "none")
    return got.select("doc", F.array_join("domains", ",").alias("domains"), "origin")


def tag_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of the grid scored against the label of the summary."""
    rows = _scores(spark, sf).withColumn("s", F.explode(tg.settings())).select(
        "doc", "is_passage", "hint", "s", tg.candidates(F.col("scores"), F.col("s.floor") - 0.2, F.col("s.close")).alias("tags")
    )
    found = tg.document_tags(rows, ["s", "doc"], F.col("s.share"), F.col("s.min_passages"), "none")
    truth = table(spark, sf, "embeddings").where("vec_id % 5 = 0").select(F.expr("vec_id div 5").alias("doc"), F.array(F.concat(F.lit("d"), F.col("label").cast("string"))).alias("domains"))
    counts = tg.label_counts(found, truth, ["s"], "doc")
    return counts.select(*[F.round(F.col(f"s.{c}") * 100).cast("int").alias(c) for c in ("floor", "close", "share")], "s.min_passages", "tp", "fp", "fn")


QUERIES = {f.__name__: f for f in (item_tags, document_tags, tag_grid)}

_SC = """pm AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
sc AS (SELECT e.vec_id, e.vec_id // 5 AS doc, e.vec_id % 5 <> 0 AS is_passage, CASE WHEN e.vec_id // 5 % 3 = 0 THEN 'd' || e.label END AS hint, 'd' || p.label AS domain,
  list_dot_product(CAST(e.embedding AS DOUBLE[]), p.m) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(p.m, p.m))) AS score
  FROM embeddings e, pm p)"""


def _tags(by: str, floor: str, close: str, score: str = "score") -> str:
    return f"""SELECT *, {score} AS v FROM (SELECT *, max({score}) OVER (PARTITION BY {by}vec_id) AS best FROM {{src}}) WHERE {score} >= {floor} AND {score} >= best - {close}"""


def _docs(by: str, src: str, tags: str, share: str, least: str) -> str:
    """Documents' domains as rows, with their origin."""
    return f"""tg AS ({tags}),
  al AS (SELECT {by}doc, any_value(hint) AS hint FROM {src} GROUP BY ALL),
  td AS (SELECT {by}doc, count(DISTINCT vec_id) AS tagged FROM tg WHERE is_passage GROUP BY ALL),
  cn AS (SELECT {by}doc, domain, count(*) FILTER (is_passage) AS n, count(*) FILTER (NOT is_passage) AS n_other FROM tg GROUP BY ALL),
  pa AS (SELECT cn.*, coalesce(tagged, 0) AS tagged, CASE WHEN tagged > 0 THEN floor(n * 1000 / tagged + 0.5) END AS part, max(n_other) OVER (PARTITION BY {', '.join(f'cn.{c}' for c in (by + 'doc').split(', '))}) AS mo
    FROM cn LEFT JOIN td USING ({by}doc)),
  ow AS (SELECT {by}doc, domain, part FROM pa WHERE n > 0 AND part >= {share} * 1000 - 1e-9 AND (n >= least({least}, tagged) OR part >= 500)),
  ot AS (SELECT {by}doc, domain FROM pa WHERE n_other > 0 AND n_other = mo AND ({by}doc) NOT IN (SELECT ({by}doc) FROM ow)),
  rs AS (SELECT {by}doc, domain, -part AS o, 'passages' AS origin FROM ow UNION ALL SELECT {by}doc, domain, 0, 'items' FROM ot
    UNION ALL SELECT {by}doc, coalesce(hint, 'none'), 0, CASE WHEN hint IS NULL THEN 'default' ELSE 'hint' END FROM al
      WHERE ({by}doc) NOT IN (SELECT ({by}doc) FROM ow) AND ({by}doc) NOT IN (SELECT ({by}doc) FROM ot))"""


_BONUS = "(score + CASE WHEN domain = hint THEN 0.05::DOUBLE ELSE 0 END)"
_GRID = ", ".join(f"({f}::DOUBLE, {c}::DOUBLE, {s}::DOUBLE, {m})" for f in tg.GRID["floor"] for c in tg.GRID["close"] for s in tg.GRID["share"] for m in tg.GRID["min_passages"])
_PLAIN = _tags("", str(FLOOR), str(CLOSE)).format(src="sc")
_SET = _tags("floor, close, share, min_passages, ", "floor - 0.2::DOUBLE", "close").format(src="(SELECT * FROM sc, st)")
_BY = "floor, close, share, min_passages, "
SQL = {
    "item_tags": f"""WITH {_SC}, t AS ({_tags('', str(FLOOR), str(CLOSE), _BONUS).format(src='sc')})
        SELECT e.vec_id, coalesce(string_agg(t.domain, ',' ORDER BY v DESC, t.domain), '') AS tags FROM embeddings e LEFT JOIN t USING (vec_id) GROUP BY e.vec_id""",
    "document_tags": f"WITH {_SC}, {_docs('', 'sc', _PLAIN, str(SHARE), str(MIN_PASSAGES))} SELECT doc, string_agg(domain, ',' ORDER BY o, domain) AS domains, any_value(origin) AS origin FROM rs GROUP BY doc",
    "tag_grid": f"""WITH {_SC}, st(floor, close, share, min_passages) AS (VALUES {_GRID}), {_docs(_BY, '(SELECT * FROM sc, st)', _SET, 'share', 'min_passages')},
        tr AS (SELECT vec_id // 5 AS doc, 'd' || label AS want FROM embeddings WHERE vec_id % 5 = 0),
        hit AS (SELECT {_BY}doc, count(*) AS n, count(*) FILTER (domain = want) AS tp FROM rs JOIN tr USING (doc) GROUP BY ALL)
        SELECT CAST(round(floor * 100) AS INTEGER) AS floor, CAST(round(close * 100) AS INTEGER) AS close, CAST(round(share * 100) AS INTEGER) AS share, min_passages,
          CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n - tp) AS BIGINT) AS fp, CAST(sum(1 - tp) AS BIGINT) AS fn FROM hit GROUP BY ALL""",
}

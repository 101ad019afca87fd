"""Queries on moments, sections, ids and repaired words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import books as bk
from gleanery.functions import records as rc
from gleanery.functions.text import STOPWORDS, ascii_words
from gleanery.operators import spans as sp
from gleanery.operators.books import repair_ligatures
from gleanery.session import table


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "items").where("doc_id NOT IN ('', '-1') AND start_ms >= 0").select("item_id", "doc_id", "source_kind", "start_ms", "end_ms", "year").distinct()


def moment_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Moment of every item by the kind its document id tells, and the id read back."""
    doc = F.when(F.col("source_kind") == "article", F.concat(F.lit("w-"), "doc_id")).when(
        F.col("source_kind") == "chapter", F.concat(F.lit("book__"), "doc_id")
    ).otherwise(F.col("doc_id"))
    return _items(spark, sf).select("item_id", doc.alias("doc"), "start_ms").select(
        "item_id", rc.kind_of_id(F.col("doc")).alias("kind"), rc.moment_id(F.col("doc"), F.col("start_ms")).alias("moment")
    ).withColumn("p", rc.parse_moment(F.col("moment"))).select("item_id", "kind", "moment", F.col("p.doc_id").alias("doc"), F.col("p.start").alias("start"))


def graded_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Items as graded spans of their document, each two-minute moment with its best grade."""
    spans = _items(spark, sf).select("doc_id", F.expr("start_ms div 1000").alias("lo"), F.expr("end_ms div 1000").alias("hi"), (F.coalesce("year", F.lit(0)) % 4).alias("grade"))
    return sp.graded_moments(spans, ["doc_id"], "lo", "hi", "grade")


def _cues(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "transcripts").where("utterances IS NOT NULL").select("doc_id", F.explode("utterances").alias("u"))
        .select("doc_id", "u.start_ms", "u.end_ms", "u.text").where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND text IS NOT NULL").distinct()
    )


def moment_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of every two-minute moment of a talk, in order, with their signs."""
    cues = _cues(spark, sf)
    lo, hi = F.expr("start_ms div 1000"), F.expr("greatest(end_ms, start_ms + 1000) div 1000")
    return (
        cues.select("doc_id", "start_ms", "text", F.explode(sp.moments_of(lo, hi)).alias("moment"))
        .groupBy("doc_id", "moment").agg(F.array_sort(F.collect_list(F.struct("start_ms", "text"))).alias("t"))
        .select("doc_id", "moment", F.size("t").cast("long").alias("n_cues"), F.length(F.array_join("t.text", " ")).cast("long").alias("n_signs"))
    )


def nearest_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Items moved to the nearest cue of their talk, made contiguous."""
    items = _items(spark, sf).selectExpr("item_id", "try_cast(doc_id AS BIGINT) AS doc_id", "start_ms AS at_ms")
    points = _cues(spark, sf).select("doc_id", F.col("start_ms").alias("snapped"))
    near = sp.nearest_point(items, points, "doc_id", "at_ms", "snapped").where("snapped IS NOT NULL")
    return sp.contiguous(near, "doc_id", "snapped", "item_id").select("item_id", "doc_id", "snapped", F.col("end").alias("ends"))


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of a page between its headings."""
    lines = table(spark, sf, "web_raw").where("html IS NOT NULL").select("raw_path", F.posexplode(F.split("html", "\n")).alias("pos", "line"))
    head = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("line", r"(?i)<h[1-3][^>]*>(.*)$", 1), "<[^>]*>", "")), F.lit(""))
    carried = F.last("h", ignorenulls=True).over(Window.partitionBy("raw_path").orderBy("pos"))
    marked = lines.withColumn("h", head).withColumn("heading", carried)
    return sp.sections(marked, "raw_path", "pos", "heading").select("raw_path", "section_no", "heading", "first_pos", "end_pos")


def passage_trims(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut to 120 words and wrapped as untrusted text, by hash."""
    short = rc.trimmed(F.col("text"), 120)
    return table(spark, sf, "documents").where("text IS NOT NULL").select(
        "doc_id", F.sha2(short, 256).alias("trim_sha"), F.length(rc.wrapped(F.col("doc_id").cast("string"), short)).cast("long").alias("n_signs")
    )


def gap_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and series as lines "question | domain"; those whose domain has
    items in the library are no gaps any more."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("title", F.lit("# none")), F.lit(" | "), F.coalesce("source", F.lit(""))).alias("line"), F.col("source"))
    asked = docs.withColumn("q", rc.gap_question(F.col("line"))).where("q IS NOT NULL").select("doc_id", "q.question", "q.domain")
    filled = table(spark, sf, "web_pages").select(F.lower(F.trim("source_id")).alias("domain")).where("domain <> ''").distinct()
    return asked.join(filled, "domain", "left_anti").select("doc_id", F.length("question").alias("n_signs"), "domain")


def question_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Content words of a title that its text has, in millionths; fit if 6 to
    45 words long and at most half of them leak."""
    overlap = rc.word_overlap(F.col("title"), F.col("text"), STOPWORDS)
    n = F.size(F.filter(F.split(F.trim("title"), " +"), lambda w: w != ""))
    return table(spark, sf, "documents").where("title IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.floor(overlap * 1e6 + 0.5).cast("long").alias("overlap_micro"), (n.between(6, 45) & (overlap <= 0.5)).alias("fits")
    )


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents by seeded hash, per source."""
    mine = rc.hash_share("9", F.col("doc_id").cast("string")) < 0.33
    return table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("n_in")
    )


def new_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose items name topics that no human label of the document's series has."""
    items = table(spark, sf, "items").where("doc_id NOT IN ('', '-1')").select("doc_id", "series", F.explode("topics").alias("topic")).distinct()
    known = items.where("series <> ''").groupBy("series", "topic").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").select("series", "topic")
    return items.join(known, ["series", "topic"], "left_anti").groupBy("doc_id").agg(F.countDistinct("topic").alias("n_new"))


def own_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with a ligature that the texts spell themselves, with their counts."""
    return (
        table(spark, sf, "documents").where("text IS NOT NULL")
        .select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]*f[filf][a-z]*"), F.lit(0))).alias("word"))
        .where(F.length("word").between(3, 24)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def ligature_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Words whose ligatures a bad font turned into signs, repaired by the
    texts' own words."""
    vocab = own_words(spark, sf)
    damaged = vocab.select("word", F.regexp_replace("word", "ffi|ffl|ff|fi|fl", "@").alias("core"))
    fixed = repair_ligatures(damaged.select("core").distinct(), "core", vocab)
    return damaged.join(fixed, "core").select("word", "core", "fixed", (F.col("fixed") == F.col("word")).alias("same"))


def series_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of titles, unique within a series by their ordinal, and
    whether a title is front or back matter."""
    docs = table(spark, sf, "documents").where("title IS NOT NULL AND series IS NOT NULL").select("doc_id", "series", "title", bk.slug(F.col("title"), 48).alias("slug"))
    again = F.row_number().over(Window.partitionBy("series", "slug").orderBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("series").orderBy("doc_id"))
    return docs.withColumn("again", again).withColumn("place", place).select(
        "doc_id", F.when(F.col("again") > 1, F.concat("slug", F.lit("-"), F.col("place").cast("string"))).otherwise(F.col("slug")).alias("chapter"),
        bk.is_matter(F.col("title")).alias("matter"),
    )


def pack_hash(spark: SparkSession, sf: str) -> DataFrame:
    """K5 K6 K8: rows of the pack of a domain in id order, their number and content
    hash; rows of one id must be the same record."""
    items = table(spark, sf, "items").where("item_id IS NOT NULL").select("item_id", "kind", "doc_id", "text", "domains", "year").distinct()
    chosen = items.where(F.exists(F.coalesce("domains", F.array(F.lit("startup"))), lambda d: d == "startup"))
    line = F.concat_ws("\x1f", "item_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "doc_id", "text", "year")])
    parts = chosen.groupBy(F.substring("item_id", 1, 8).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("n_ids"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h")
    )
    whole = F.array_sort(F.collect_list(F.struct("part", "h")))
    return parts.agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("n_ids")).alias("n_duplicate"), F.sha2(F.array_join(F.transform(whole, lambda x: x["h"]), "\n"), 256).alias("sha"))


def hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic vectors of the titles, as the counts of their places in thousandths."""
    v = rc.hash_embedding(F.col("title"))
    docs = table(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", F.posexplode(v).alias("place", "x")).where("x > 0")
    return docs.groupBy("place").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.floor(F.col("x") * 1000).cast("long")).alias("weight"))


QUERIES = {f.__name__: f for f in (
    hash_vectors, moment_ids, graded_moments, moment_texts, nearest_snap, heading_sections, passage_trims, gap_questions, question_leakage, hash_split,
    new_labels, own_words, ligature_repair, series_slugs, pack_hash,
)}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_I = "i AS (SELECT DISTINCT item_id, doc_id, source_kind, start_ms, end_ms, year FROM items WHERE doc_id NOT IN ('', '-1') AND start_ms >= 0)"
_C = """c AS (SELECT DISTINCT doc_id, u.start_ms, u.end_ms, u.text FROM (SELECT doc_id, unnest(utterances) AS u FROM transcripts WHERE utterances IS NOT NULL) x
  WHERE u.start_ms IS NOT NULL AND u.end_ms IS NOT NULL AND u.text IS NOT NULL)"""
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_OWN = "ow AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]*f[filf][a-z]*')) AS word FROM documents) WHERE length(word) BETWEEN 3 AND 24 GROUP BY word)"


def _cw(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9'']+')), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


SQL = {
    "hash_vectors": f"""WITH w AS (SELECT doc_id, regexp_replace(unnest(list_filter(string_split_regex(trim(lower(title)), '{_WS}'), lambda x: x <> '')), '^[.,?!''"]+|[.,?!''"]+$', '', 'g') AS w FROM documents WHERE title IS NOT NULL),
        c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 31, 2) AS INTEGER) % 64 AS place, count(*) AS n FROM w GROUP BY ALL),
        x AS (SELECT doc_id, place, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS x FROM c)
        SELECT place, count(*) AS n_docs, CAST(sum(floor(CAST(x AS DOUBLE) * 1000)) AS BIGINT) AS weight FROM x GROUP BY place""",
    "moment_ids": f"""WITH {_I}, k AS (SELECT item_id, CASE source_kind WHEN 'article' THEN 'article' WHEN 'chapter' THEN 'chapter' ELSE 'talk' END AS kind,
          CASE source_kind WHEN 'article' THEN 'w-' || doc_id WHEN 'chapter' THEN 'book__' || doc_id ELSE doc_id END AS doc, start_ms FROM i),
        m AS (SELECT *, CASE kind WHEN 'talk' THEN start_ms // 60000 * 60 WHEN 'article' THEN CAST(floor((start_ms - 1) / 3) AS BIGINT) * 3 + 1 ELSE start_ms // 1000 END AS start FROM k)
        SELECT item_id, kind, doc || '_' || CASE kind WHEN 'article' THEN 'p' WHEN 'chapter' THEN 'b' ELSE '' END
          || CASE WHEN start < 10000 THEN lpad(CAST(start AS VARCHAR), 5, '0') ELSE CAST(start AS VARCHAR) END AS moment, doc, start FROM m""",
    "graded_moments": f"""WITH {_I}, s AS (SELECT doc_id, start_ms // 1000 AS lo, end_ms // 1000 AS hi, coalesce(year, 0) % 4 AS grade FROM i WHERE end_ms // 1000 > start_ms // 1000)
        SELECT doc_id, m * 60 AS moment, max(grade) AS grade FROM (SELECT *, unnest(range(0, hi // 60 + 1)) AS m FROM s) x WHERE m * 60 < hi AND m * 60 + 120 > lo GROUP BY ALL""",
    "moment_texts": f"""WITH {_C}, s AS (SELECT doc_id, start_ms, text, start_ms // 1000 AS lo, greatest(end_ms, start_ms + 1000) // 1000 AS hi FROM c)
        SELECT doc_id, m * 60 AS moment, count(*) AS n_cues, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_signs
        FROM (SELECT *, unnest(range(0, hi // 60 + 1)) AS m FROM s) x WHERE m * 60 < hi AND m * 60 + 120 > lo GROUP BY ALL""",
    "nearest_snap": f"""WITH {_I}, {_C}, p AS (SELECT DISTINCT doc_id, start_ms AS snapped FROM c),
        n AS (SELECT item_id, p.doc_id, arg_min(snapped, (abs(snapped - start_ms), snapped)) AS snapped FROM i JOIN p ON p.doc_id = TRY_CAST(i.doc_id AS BIGINT) GROUP BY item_id, p.doc_id)
        SELECT item_id, doc_id, snapped, lead(snapped) OVER (PARTITION BY doc_id ORDER BY snapped, item_id) AS ends FROM n""",
    "heading_sections": """WITH l AS (SELECT raw_path, unnest(string_split(html, chr(10))) AS line, unnest(range(len(string_split(html, chr(10))))) AS pos FROM web_raw WHERE html IS NOT NULL),
        h AS (SELECT raw_path, pos, nullif(trim(regexp_replace(regexp_extract(line, '(?i)<h[1-3][^>]*>(.*)$', 1), '<[^>]*>', '', 'g')), '') AS h FROM l),
        s AS (SELECT raw_path, pos, h, lag(h) OVER (PARTITION BY raw_path ORDER BY pos) AS b FROM h WHERE h IS NOT NULL)
        SELECT raw_path, CAST(row_number() OVER w AS INTEGER) AS section_no, h AS heading, CAST(pos AS INTEGER) AS first_pos, CAST(lead(pos) OVER w AS INTEGER) AS end_pos
        FROM s WHERE b IS NULL OR b <> h WINDOW w AS (PARTITION BY raw_path ORDER BY pos)""",
    "passage_trims": f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, array_to_string(w[1:120], ' ') || CASE WHEN len(w) > 120 THEN ' …' ELSE '' END AS s FROM w)
        SELECT doc_id, sha256(s) AS trim_sha, CAST(length(replace(s, '</untrusted_source>', '')) + length('<untrusted_source item_id="">' || doc_id || '</untrusted_source>') AS BIGINT) AS n_signs FROM s""",
    "gap_questions": """WITH f AS (SELECT DISTINCT lower(trim(source_id)) AS d FROM web_pages)
        SELECT doc_id, CAST(length(trim(string_split(title, '|')[1])) AS INTEGER) AS n_signs, coalesce(source, '') AS domain FROM documents
        WHERE title IS NOT NULL AND trim(string_split(title, '|')[1]) <> '' AND trim(title) NOT LIKE '#%' AND coalesce(source, '') NOT IN (SELECT d FROM f WHERE d <> '')""",
    "question_leakage": f"""WITH o AS (SELECT doc_id, title, {_cw('title')} AS q, {_cw('text')} AS t FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
        r AS (SELECT doc_id, len(list_filter(string_split_regex(trim(title), ' +'), lambda w: w <> '')) AS n, CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(q, t)) / len(q) END AS o FROM o)
        SELECT doc_id, CAST(floor(o * 1e6 + 0.5) AS BIGINT) AS overlap_micro, n BETWEEN 6 AND 45 AND o <= 0.5 AS fits FROM r""",
    "hash_split": """SELECT coalesce(source, '') AS source, count(*) AS n, count(*) FILTER (CAST('0x' || substr(sha256('9:' || doc_id), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.33) AS n_in
        FROM documents GROUP BY coalesce(source, '')""",
    "new_labels": """WITH t AS (SELECT DISTINCT doc_id, series, unnest(topics) AS topic FROM items WHERE doc_id NOT IN ('', '-1')),
        k AS (SELECT series, topic FROM t WHERE series <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) > 1)
        SELECT doc_id, count(DISTINCT topic) AS n_new FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.series = t.series AND k.topic = t.topic) GROUP BY doc_id""",
    "own_words": f"WITH {_OWN} SELECT word, n FROM ow",
    "ligature_repair": f"""WITH {_OWN}, d AS (SELECT word, n, regexp_replace(word, 'ffi|ffl|ff|fi|fl', '@', 'g') AS core FROM ow),
        ok AS (SELECT DISTINCT core FROM d WHERE length(core) - length(replace(core, '@', '')) <= 2 AND length(regexp_replace(core, '[^a-z]', '', 'g')) >= 3),
        b AS (SELECT ok.core, arg_max(v.word, (v.n, v.word)) AS fixed FROM ok JOIN d v ON v.core = ok.core GROUP BY ok.core)
        SELECT d.word, d.core, b.fixed, b.fixed = d.word AS same FROM d JOIN b ON b.core = d.core""",
    "series_slugs": """WITH s AS (SELECT doc_id, series, title, CASE WHEN c = '' THEN 'untitled' ELSE c END AS slug FROM (
          SELECT doc_id, series, title, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '', 'g') AS c
          FROM documents WHERE title IS NOT NULL AND series IS NOT NULL))
        SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY series, slug ORDER BY doc_id) > 1 THEN slug || '-' || row_number() OVER (PARTITION BY series ORDER BY doc_id) ELSE slug END AS chapter,
          regexp_matches(lower(trim(title)), '^(cover|copyright|foreword|index|notes|contents|dedication|about the author)') AS matter FROM s""",
    "pack_hash": """WITH i AS (SELECT DISTINCT item_id, kind, doc_id, text, domains, year FROM items WHERE item_id IS NOT NULL),
        c AS (SELECT item_id, concat_ws(chr(31), item_id, coalesce(kind, ''), coalesce(doc_id, ''), coalesce(text, ''), coalesce(CAST(year AS VARCHAR), '')) AS line FROM i
          WHERE list_contains(coalesce(domains, ['startup']), 'startup')),
        p AS (SELECT substr(item_id, 1, 8) AS part, count(*) AS n, count(DISTINCT item_id) AS ids, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM c GROUP BY ALL)
        SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - sum(ids) AS BIGINT) AS n_duplicate, sha256(string_agg(h, chr(10) ORDER BY part)) AS sha FROM p""",
}

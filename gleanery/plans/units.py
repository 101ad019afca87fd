"""Queries on text units: captions, paragraphs, quotes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as ft
from gleanery.operators import segments as sg
from gleanery.plans.dialect import plans
from gleanery.session import table

TEXTS = {
    "text_units": """-- W38 X8: paragraphs of a document with their number and moment
        WITH u AS (SELECT doc_id, [[split:text¦'\n']] AS p FROM {documents} WHERE text IS NOT NULL)
        SELECT doc_id, CAST(sum([[size:p]]) AS BIGINT) AS n_units, CAST(max([[div:[[size:p]] - 1¦3]] * 3 + 1) AS BIGINT) AS last_moment FROM u GROUP BY doc_id""",
    "caption_quality": """-- A1 X3: words and marks of a document's text, unpunctuated under half a percent
        WITH w AS (SELECT doc_id, [[size:[[findall:lower(text)¦'[a-z0-9]+']]]] AS n_words, [[size:[[distinct:[[findall:lower(text)¦'[a-z0-9]+']]]]]] AS n_types,
            [[size:[[findall:text¦'[.,;:?!]']]]] AS n_marks, [[size:[[findall:text¦'[(][^)]*[)]']]]] AS n_notes FROM {documents} WHERE text IS NOT NULL)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_types AS BIGINT) AS n_types, CAST(n_marks AS BIGINT) AS n_marks, CAST(n_notes AS BIGINT) AS n_notes,
          CASE WHEN n_words > 0 THEN CAST([[div:n_marks * 10000¦greatest(1, n_words)]] AS BIGINT) ELSE 0 END AS marks_per_10k, CASE WHEN n_words > 0 THEN CAST([[div:n_types * 1000¦greatest(1, n_words)]] AS BIGINT) ELSE 0 END AS types_milli,
          n_words > 0 AND n_marks * 200 < n_words AS unpunctuated FROM w""",
    "interval_overlap_moments": """-- J10 J11 X9: cues spread over the two-minute moments they overlap
        WITH t AS (SELECT DISTINCT doc_id, version, utterances FROM {transcripts} WHERE utterances IS NOT NULL),
        u AS (SELECT doc_id, [[rows:utterances]] AS u FROM t),
        c AS (SELECT doc_id, u.start_ms AS s, u.end_ms AS e FROM u WHERE u.start_ms IS NOT NULL AND u.end_ms > u.start_ms),
        m AS (SELECT doc_id, [[rows:[[range:[[div:s¦120000]]¦[[div:e - 1¦120000]]]]]] AS moment FROM c)
        SELECT doc_id, CAST(moment AS BIGINT) AS moment, CAST(count(*) AS BIGINT) AS n_cues FROM m GROUP BY doc_id, moment""",
    "corpus_stats": """-- A2 A3: items, documents, speakers and years by kind
        SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(DISTINCT speaker) AS BIGINT) AS n_speakers,
          min(CASE WHEN year > 0 THEN year END) AS first_year, max(year) AS last_year
        FROM (SELECT DISTINCT item_id, kind, doc_id, speaker, year FROM {items}) i GROUP BY kind""",
    "domain_counts": """-- A3: items per topic, an item counts for each
        SELECT topic, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT item_id, [[rows:topics]] AS topic FROM {items}) t GROUP BY topic""",
    "context_header": """-- X4 X5: header sentence of an item
        SELECT DISTINCT item_id, concat('From ', CASE WHEN source_kind = 'chapter' THEN 'the book ' ELSE 'the talk ' END, coalesce(title, ''),
          CASE WHEN coalesce(speaker, '') <> '' THEN concat(' by ', speaker) ELSE '' END, CASE WHEN year > 0 THEN concat(' (', CAST(year AS VARCHAR(8)), ')') ELSE '' END, '.') AS header FROM {items}""",
    "deep_links": """-- X6 X7: link and minute label of an item by its kind
        SELECT DISTINCT item_id, CASE WHEN start_ms < 0 OR start_ms IS NULL THEN deep_link ELSE concat('#t=', CAST([[div:start_ms¦1000]] AS VARCHAR(12)), 's') END AS link,
          CASE WHEN start_ms >= 0 THEN concat(CAST([[div:start_ms¦60000]] AS VARCHAR(8)), ':', lpad(CAST([[div:start_ms¦1000]] % 60 AS VARCHAR(2)), 2, '0')) END AS label FROM {items}""",
    "eligible_seeds": """-- F7 F16: items that may seed a question
        SELECT DISTINCT item_id FROM {items} WHERE kind IN ('advice', 'takeaway') AND coalesce(evidence, '') <> '' AND start_ms >= 0 AND coalesce(source_kind, '') <> ''""",
    "english_tracks": """-- F13 F14: documents whose language's primary subtag is English, by caption kind
        SELECT [[tidy:caption_kind]] AS caption_kind, CAST(count(*) AS BIGINT) AS n FROM {documents} WHERE [[extract:lower(lang)¦'^([a-z]+)']] = 'en' AND caption_kind IS NOT NULL GROUP BY [[tidy:caption_kind]]""",
    "dedup_by_text": """-- E5 E3: items of equal normal text, first id kept
        SELECT item_id, CAST(n AS BIGINT) AS n FROM (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY item_id) AS rn, count(*) OVER (PARTITION BY k) AS n FROM (
          SELECT DISTINCT item_id, trim([[replace:lower(text)¦'[^a-z0-9]+'¦' ']]) AS k FROM {items} WHERE text IS NOT NULL) a) b WHERE rn = 1""",
    "page_links": """-- S2 S5 N13: internal links of a page by their first path part
        SELECT part, CAST(count(*) AS BIGINT) AS n FROM (SELECT [[rows:[[findall:lower(html)¦'href="/[a-z-]+']]]] AS part FROM {web_raw}) l GROUP BY part""",
    "json_getters": """-- M16 K8 S12: titles held in the JSON of books and revisions of nodes
        SELECT CAST([[json:props¦'$.rev']] AS BIGINT) AS rev, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT node_id, props FROM {nodes} WHERE props LIKE '%rev%') p GROUP BY 1""",
    "index_scan": """-- S14 S15 W16 K7: projected scan of the item index with defaults for missing cells
        SELECT DISTINCT item_id, coalesce(kind, '') AS kind, coalesce(year, -1) AS year, coalesce(series, '') AS series FROM {items} WHERE kind IN ('advice', 'fact')""",
}
QUERIES, SQL = plans(TEXTS)


def _cues(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "transcripts").where("utterances IS NOT NULL")
        .select("doc_id", "version", "utterances").distinct()
        .select("doc_id", F.posexplode("utterances").alias("cue_no", "u"))
        .select("doc_id", "cue_no", "u.start_ms", "u.end_ms", "u.text")
        .where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    )


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents").where("text IS NOT NULL")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .withColumn("pos", F.col("pos").cast("long"))
    )


def rolling_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a cue that the cue before it did not end with."""
    return sg.rolling_dedup(_cues(spark, sf)).select("doc_id", "cue_no", "n_dropped", F.length("fresh").alias("n_chars"))


def utterance_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Cues merged into utterances."""
    return sg.merge_utterances(_cues(spark, sf))


def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of paragraphs with carried overlap."""
    return sg.chunk_units(_units(spark, sf))


def parent_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Parent windows of 2000 tokens."""
    return sg.greedy_windows(_units(spark, sf), 2000)


def extraction_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction windows of 8000 tokens and their item budget."""
    return (
        sg.greedy_windows(_units(spark, sf), 8000).groupBy("doc_id", "window_no").agg(F.count(F.lit(1)).alias("n_units"))
        .withColumn("item_budget", F.greatest(F.lit(2), F.least(F.lit(40), F.bround(F.col("n_units") / 4).cast("int"))))
    )


def long_unit_split(spark: SparkSession, sf: str) -> DataFrame:
    """Units over 40 words in equal parts."""
    return sg.split_long(_units(spark, sf), 40)


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of series names: singular form, slug, entity form."""
    return table(spark, sf, "documents").where("series IS NOT NULL").select(
        "series", ft.singular_key(F.col("series")).alias("name_key"), ft.slug(F.col("series")).alias("slug"),
        ft.entity_key(F.col("series")).alias("entity"),
    ).distinct()


def garbled_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units judged garbled by their letters."""
    return _units(spark, sf).groupBy(ft.garbled(F.col("text")).alias("garbled")).agg(F.count(F.lit(1)).alias("n_units"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Short hash of every text, case and spacing ignored."""
    norm = F.trim(F.regexp_replace(F.lower("text"), "[ \t\r\n]+", " "))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", ft.content_hash(norm).alias("hash"))


def asof_section(spark: SparkSession, sf: str) -> DataFrame:
    """Last item of the document that starts at or before each cue."""
    items = (
        table(spark, sf, "items").where("doc_id NOT IN ('', '-1') AND start_ms >= 0 AND item_id IS NOT NULL")
        .selectExpr("try_cast(doc_id AS BIGINT) AS doc_id", "start_ms AS at_s", "item_id").distinct()
    )
    cues = (
        table(spark, sf, "transcripts").where("utterances IS NOT NULL").select("doc_id", F.explode("utterances.start_ms").alias("at_s"))
        .where("at_s IS NOT NULL").distinct()
    )
    both = items.withColumn("cue", F.lit(0)).unionByName(cues.withColumn("cue", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("at_s", "cue", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("item_id", F.last("item_id", ignorenulls=True).over(before))
        .where("cue = 1 AND item_id IS NOT NULL").select("doc_id", "at_s", "item_id")
    )


def index_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """One hash over the documents in id order, each by its id, text and
    latest transcript version; hashed by ranges of ids, then over the ranges."""
    latest = table(spark, sf, "transcripts").groupBy("doc_id").agg(F.max("version").alias("version"))
    rows = (
        table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash")).distinct()
        .join(latest, "doc_id", "left")
        .withColumn("line", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text_hash", "version")]))
    )

    def ordered(key: str, cell: str):
        pairs = F.sort_array(F.collect_list(F.struct(key, cell)))
        return F.sha2(F.array_join(F.transform(pairs, lambda x: x[cell]), "\n"), 256)

    ranges = rows.groupBy(F.floor(F.col("doc_id") / 10000).alias("part")).agg(ordered("doc_id", "line").alias("hash"))
    return ranges.agg(ordered("part", "hash").alias("fingerprint"))


QUERIES |= {
    f.__name__: f
    for f in (
        rolling_dedup, utterance_merge, chunk_overlap, parent_windows, extraction_windows, long_unit_split,
        name_keys, garbled_units, content_hashes, asof_section, index_fingerprint,
    )
}
_UNITS = "u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)"
_TOK = r"CAST(floor(len(list_filter(string_split_regex(trim(text), '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]+'), lambda w: w <> '')) * 1.33) AS BIGINT)"
SQL["utterance_merge"] = """
    WITH RECURSIVE t AS (SELECT DISTINCT doc_id, version, utterances FROM transcripts WHERE utterances IS NOT NULL),
    x AS (SELECT doc_id, unnest(utterances) AS u FROM t),
    c AS (SELECT doc_id, u.start_ms AS s, u.end_ms AS e, row_number() OVER (PARTITION BY doc_id ORDER BY u.start_ms, u.end_ms) AS i
          FROM x WHERE u.start_ms IS NOT NULL AND u.end_ms IS NOT NULL),
    f(doc_id, i, gs, ge, g) AS (
      SELECT doc_id, i, s, e, 1 FROM c WHERE i = 1
      UNION ALL
      SELECT c.doc_id, c.i, CASE WHEN c.e - f.gs > 25000 OR c.s - f.ge > 1200 THEN c.s ELSE f.gs END,
        CASE WHEN c.e - f.gs > 25000 OR c.s - f.ge > 1200 THEN c.e ELSE greatest(f.ge, c.e) END,
        CASE WHEN c.e - f.gs > 25000 OR c.s - f.ge > 1200 THEN f.g + 1 ELSE f.g END
      FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1)
    SELECT doc_id, gs AS start_ms, max(ge) AS end_ms, CAST(count(*) AS INTEGER) AS n_cues FROM f GROUP BY doc_id, g, gs"""
SQL["content_hashes"] = r"""SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' ')), 1, 16) AS hash FROM documents WHERE text IS NOT NULL"""
SQL["garbled_units"] = f"""WITH {_UNITS} SELECT CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 20
      THEN length(regexp_replace(lower(text), '[^rnhiflm]', '', 'g')) < length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 0.1 END AS garbled,
      CAST(count(*) AS BIGINT) AS n_units FROM u GROUP BY ALL"""
SQL["asof_section"] = """WITH i AS (SELECT DISTINCT item_id, TRY_CAST(doc_id AS BIGINT) AS doc_id, start_ms FROM items
      WHERE doc_id NOT IN ('', '-1') AND start_ms >= 0 AND item_id IS NOT NULL),
    c AS (SELECT DISTINCT doc_id, u.start_ms AS at_s FROM (SELECT doc_id, unnest(utterances) AS u FROM transcripts WHERE utterances IS NOT NULL) x WHERE u.start_ms IS NOT NULL)
    SELECT c.doc_id, c.at_s, max_by(i.item_id, (i.start_ms, i.item_id)) AS item_id FROM c JOIN i ON i.doc_id = c.doc_id AND i.start_ms <= c.at_s GROUP BY ALL"""
SQL["index_fingerprint"] = """WITH v AS (SELECT doc_id, max(version) AS version FROM transcripts GROUP BY doc_id),
    r AS (SELECT DISTINCT d.doc_id, coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || coalesce(sha256(text), '') || '|' || coalesce(CAST(version AS VARCHAR), '') AS line
      FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id),
    p AS (SELECT CAST(floor(doc_id / 10000) AS BIGINT) AS part, sha256(string_agg(line, chr(10) ORDER BY doc_id, line)) AS hash FROM r GROUP BY ALL)
    SELECT sha256(string_agg(hash, chr(10) ORDER BY part)) AS fingerprint FROM p"""
_FLAT = f"""{_UNITS}, z AS (SELECT doc_id, pos, {_TOK} AS t FROM u),
  d AS (SELECT doc_id, list(pos ORDER BY pos) AS pos, list(t ORDER BY pos) AS t FROM z GROUP BY doc_id),
  cum AS (SELECT doc_id, pos, t, list_transform(range(0, len(t) + 1), lambda k: coalesce(list_sum(t[1:k]), 0)) AS c FROM d)"""
SQL["chunk_overlap"] = f"""WITH RECURSIVE {_FLAT}, r(doc_id, i, a, n, e, ea) AS (
    SELECT doc_id, 1, 1, 0, false, 0 FROM cum
    UNION ALL
    SELECT r.doc_id, r.i + 1, CASE WHEN full_ THEN list_min(list_filter(range(r.a + 1, r.i + 2), lambda j: c[r.i + 1] - c[j] <= 99)) ELSE r.a END,
      CASE WHEN full_ THEN r.n + 1 ELSE r.n END, full_, r.a
    FROM (SELECT r.*, c, t, c[r.i + 2] - c[r.a] > 550 AS full_ FROM r JOIN cum USING (doc_id) WHERE r.i < len(t)) r),
  f AS (SELECT doc_id, n - 1 AS k, ea AS a, i - 1 AS b FROM r WHERE e UNION ALL SELECT doc_id, n, a, i FROM r JOIN cum USING (doc_id) WHERE i = len(t))
  SELECT f.doc_id, CAST(k AS INTEGER) AS chunk_no, pos[a] AS first_pos, pos[b] AS last_pos, CAST(c[b + 1] - c[a] AS BIGINT) AS n_tokens FROM f JOIN cum USING (doc_id)"""


def _greedy(budget: int) -> str:
    return f"""{_FLAT}, r(doc_id, i, size, no) AS (
    SELECT doc_id, 1, t[1], 0 FROM cum
    UNION ALL
    SELECT r.doc_id, r.i + 1, CASE WHEN r.size > 0 AND r.size + t[r.i + 1] > {budget} THEN t[r.i + 1] ELSE r.size + t[r.i + 1] END,
      CASE WHEN r.size > 0 AND r.size + t[r.i + 1] > {budget} THEN r.no + 1 ELSE r.no END FROM r JOIN cum USING (doc_id) WHERE r.i < len(t))"""


SQL["parent_windows"] = f"WITH RECURSIVE {_greedy(2000)} SELECT r.doc_id, pos[i] AS pos, CAST(no AS INTEGER) AS window_no FROM r JOIN cum USING (doc_id)"
SQL["extraction_windows"] = f"""WITH RECURSIVE {_greedy(8000)}, n AS (SELECT doc_id, no AS window_no, count(*) AS n_units FROM r GROUP BY ALL)
    SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, n_units, CAST(greatest(2, least(40, round_even(n_units / 4, 0))) AS INTEGER) AS item_budget FROM n"""
SQL["long_unit_split"] = rf"""WITH {_UNITS}, w AS (SELECT doc_id, pos, len(list_filter(string_split_regex(trim(text), '[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{85}}]+'), lambda x: x <> '')) AS n FROM u),
    p AS (SELECT *, greatest(1, CAST(ceil(n / 40) AS INTEGER)) AS parts FROM w)
    SELECT doc_id, pos, part, CAST(greatest(0, least(ceil(n / parts), n - (part - 1) * ceil(n / parts))) AS BIGINT) AS n_words
    FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM p)"""
SQL["rolling_dedup"] = r"""WITH t AS (SELECT DISTINCT doc_id, version, utterances FROM transcripts WHERE utterances IS NOT NULL),
    c AS (SELECT doc_id, i - 1 AS cue_no, utterances[i] AS u FROM t, range(1, 100000) r(i) WHERE i <= len(utterances)),
    w AS (SELECT doc_id, cue_no, u.start_ms AS s, list_filter(string_split_regex(trim(u.text), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w
      FROM c WHERE u.start_ms IS NOT NULL AND u.end_ms IS NOT NULL),
    p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY s, cue_no) AS b FROM w WHERE len(w) > 0),
    k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(w), len(b)) + 1), lambda k: b[len(b) - k + 1:] = w[1:k])), 0) AS n FROM p)
    SELECT doc_id, CAST(cue_no AS INTEGER) AS cue_no, CAST(n AS INTEGER) AS n_dropped, CAST(length(array_to_string(w[n + 1:], ' ')) AS INTEGER) AS n_chars FROM k"""
SQL["name_keys"] = r"""SELECT DISTINCT series, array_to_string(list_transform(list_filter(string_split(regexp_replace(replace(lower(series), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> ''),
      lambda w: CASE WHEN regexp_matches(w, '..ies$') THEN w[:-4] || 'y' WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') AND length(w) > 2 THEN w[:-2] ELSE w END), ' ') AS name_key,
    regexp_replace(regexp_replace(lower(trim(series)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    trim(regexp_replace(replace(lower(series), '.', ''), '\s+', ' ', 'g')) AS entity FROM documents WHERE series IS NOT NULL"""

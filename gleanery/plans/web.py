"""Queries on web pages: addresses, declared fields, kinds and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import pages as pg
from gleanery.functions import urls as u
from gleanery.functions.text import n_words
from gleanery.session import table


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_pages").where("url IS NOT NULL").select("url").distinct()


def url_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical address, site, page id and scope of every address."""
    c = F.col("url")
    return _addresses(spark, sf).select("url", u.canonical(c).alias("canonical"), u.site(c).alias("site"), u.page_id(c).alias("page_id"), u.scope(c).alias("scope"))


def url_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """The same addresses as people write them (upper-case host, default
    port, tracking, unordered query, fragment), brought to one form."""
    odd = F.concat(
        F.lit("HTTP://"), F.upper(F.regexp_extract("url", "^https?://([^/]+)", 1)), F.lit(":80"), F.regexp_extract("url", "^https?://[^/]+(.*)$", 1),
        F.lit("?utm_source=mail&b=2%20x&gclid=7&a=1#top"),
    )
    return _addresses(spark, sf).select("url", u.canonical(odd).alias("canonical"), u.page_id(odd).alias("page_id"))


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Declared title, language and date of a page, words and links."""
    h = F.col("html")
    return table(spark, sf, "web_raw").select(
        "raw_path", pg.title(h).alias("title"), pg.language(h).alias("lang"), pg.published(h).alias("published"),
        n_words(pg.text_of(h)).alias("n_words"), F.size(pg.link_texts(h)).alias("n_links"),
    )


def page_type(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of a page from its words, links and talks, and for its source."""
    h = F.col("html")
    raw = table(spark, sf, "web_raw").select(
        "raw_path", n_words(pg.text_of(h)).alias("w"), pg.link_share(h).alias("share"), F.size(pg.link_texts(h)).alias("links"),
        F.size(F.array_distinct(F.regexp_extract_all(h, F.lit(pg.VIDEO_ID), F.lit(1)))).alias("videos"), h.rlike(pg.TRANSCRIPT_MARK).alias("mark"),
    )
    kind = pg.page_type(F.col("w"), F.col("share"), F.col("links"), F.col("videos"), F.col("mark"))
    pages = table(spark, sf, "web_pages").where("raw_path IS NOT NULL").select("raw_path", "url").distinct()
    start = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/"))
    return pages.join(raw, "raw_path").select(
        "raw_path", "url", kind.alias("kind"), pg.page_kind(kind, F.col("url"), start, F.lit(1), F.col("w"), F.lit(False)).alias("for_source")
    )


def link_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the fetched pages, made absolute, kept in scope of the
    source's start and queued at the least depth."""
    pages = table(spark, sf, "web_pages").where("raw_path IS NOT NULL AND url IS NOT NULL").select("raw_path", "url").distinct()
    hrefs = table(spark, sf, "web_raw").select("raw_path", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)))).alias("href"))
    start = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/"))
    found = pages.join(hrefs, "raw_path").select(u.absolute(F.col("url"), F.col("href")).alias("link"), start.alias("start")).where("link IS NOT NULL")
    known = pages.select(u.canonical(F.col("url")).alias("link")).distinct().withColumn("depth", F.lit(0))
    queued = found.where(u.in_scope(F.col("link"), F.col("start"))).select("link").withColumn("depth", F.lit(1)).unionByName(known)
    return queued.groupBy("link").agg(F.min("depth").cast("long").alias("depth"), F.count_if(F.col("depth") == 1).alias("n_links"))


QUERIES = {f.__name__: f for f in (url_identity, url_spellings, page_fields, page_type, link_frontier)}

_A = "a AS (SELECT DISTINCT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM web_pages WHERE url IS NOT NULL)"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_LINKS = r"regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1)"
_WORDS = r"len(list_filter(string_split_regex(t, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> ''))"
SQL = {
    "url_identity": f"""WITH {_A} SELECT url, 'https://' || lower(host) || path AS canonical, regexp_replace(lower(host), '^www[.]', '') AS site,
        'w-' || substr(sha256('//' || regexp_replace(lower(host), '^www[.]', '') || path), 1, 16) AS page_id, path || '/' AS scope FROM a""",
    "url_spellings": f"""WITH {_A} SELECT url, 'http://' || lower(host) || path || '?a=1&b=2+x' AS canonical,
        'w-' || substr(sha256('//' || regexp_replace(lower(host), '^www[.]', '') || path || '?a=1&b=2+x'), 1, 16) AS page_id FROM a""",
    "page_fields": rf"""WITH x AS (SELECT raw_path, html, {_TEXT} AS t FROM web_raw)
        SELECT raw_path, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title, CAST(NULL AS VARCHAR) AS lang,
          CAST(NULL AS VARCHAR) AS published, CASE WHEN html IS NULL THEN 0 ELSE {_WORDS} END AS n_words, len({_LINKS}) AS n_links FROM x""",
    "page_type": rf"""WITH x AS (SELECT raw_path, html, {_TEXT} AS t FROM web_raw),
        m AS (SELECT raw_path, {_WORDS} AS w, CASE WHEN length(t) > 0 THEN coalesce(list_sum(list_transform({_LINKS}, lambda l: length(trim(regexp_replace(regexp_replace(l, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))))), 0) / length(t) ELSE 0 END AS share,
          len({_LINKS}) AS links FROM x),
        k AS (SELECT raw_path, CASE WHEN w >= 150 AND share < 0.5 THEN 'article' WHEN links >= 10 THEN 'listing' ELSE 'other' END AS kind FROM m)
        SELECT DISTINCT p.raw_path, url, kind, CASE WHEN kind = 'article' AND (regexp_matches(url, '^https?://[^/]+/*$') OR regexp_matches(regexp_replace(url, '[?#].*$', ''),
            '(?i)^https?://[^/]+(/.*)?/(archives?|categor(y|ies)|tags?|topics?|authors?|search|feed|page/\d+)(/|$)')) THEN 'listing' ELSE kind END AS for_source
        FROM web_pages p JOIN k USING (raw_path)""",
    "link_frontier": r"""WITH p AS (SELECT DISTINCT raw_path, url FROM web_pages WHERE raw_path IS NOT NULL AND url IS NOT NULL),
        l AS (SELECT raw_path, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1))) AS href FROM web_raw),
        f AS (SELECT 'https://' || lower(regexp_extract(url, '^https?://([^/]+)', 1)) || href AS link FROM p JOIN l USING (raw_path) WHERE href LIKE '/%'),
        q AS (SELECT link, 1 AS depth FROM f UNION ALL SELECT DISTINCT url, 0 FROM p)
        SELECT link, CAST(min(depth) AS BIGINT) AS depth, count(*) FILTER (depth = 1) AS n_links FROM q GROUP BY link""",
}

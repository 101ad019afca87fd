"""Declared fields of HTML pages: structured data before meta tags before tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
MIN_ARTICLE_WORDS, MAX_LINK_SHARE, LISTING_LINKS = 150, 0.5, 10
LISTING_PATH = r"(?i)/(?:archives?|categor(?:y|ies)|tags?|topics?|authors?|search|feed|page/\d+)(?:/|$)"
VIDEO_ID = (
    r"(?:youtube(?:-nocookie)?\.com/(?:embed/|watch\?(?:[^\s\"'<>]*&)?v=|shorts/|live/)|youtu\.be/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])"
)
TRANSCRIPT_MARK = r"(?i)(?:>\s*|#{1,6}\s*)transcript\s*(?:<|\n|:)"
MONTHS = "january february march april may june july august september october november december".split()


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def meta(html: Column, *keys: str) -> Column:
    """Content of the first of the named meta tags."""
    found = []
    for key in keys:
        name = rf"""(?:property|name|itemprop)\s*=\s*["']{key}["']"""
        content = r"""content\s*=\s*["']([^"']*)["']"""
        found += [_blank(F.regexp_extract(html, rf"(?is)<meta\b[^>]*{name}[^>]*{content}", 1)), _blank(F.regexp_extract(html, rf"(?is)<meta\b[^>]*{content}[^>]*{name}", 1))]
    return F.coalesce(*found)


def _structured(html: Column, *paths: str) -> Column:
    raw = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    one = F.coalesce(F.get_json_object(raw, "$['@graph'][0]"), F.get_json_object(raw, "$[0]"), raw)
    return F.coalesce(*[_blank(F.get_json_object(one, p)) for p in paths])


def iso_date(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def byline_date(line: Column) -> Column:
    """Date of a line that opens with month, day if any, and year."""
    pattern = rf"(?i)^({'|'.join(MONTHS)})\s+(?:(\d{{1,2}}),\s+)?((?:19|20)\d\d)(?!\d)"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(line, pattern, 1)))
    day = F.coalesce(F.regexp_extract(line, pattern, 2).try_cast("int"), F.lit(1))
    return F.when(line.rlike(pattern), F.format_string("%s-%02d-%02d", F.regexp_extract(line, pattern, 3), month, day))


def title(html: Column) -> Column:
    tag = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")
    return F.coalesce(_structured(html, "$.headline", "$.name"), meta(html, "og:title"), _blank(tag))


def author(html: Column) -> Column:
    """A profile address is no name."""
    names = F.regexp_replace(
        F.regexp_replace(_structured(html, "$.author.name", "$.author[*].name", "$.author"), r"^\[|\]$", ""), r'"\s*,\s*"', ", "
    )
    found = F.coalesce(_blank(F.replace(names, F.lit('"'), F.lit(""))), meta(html, "author", "article:author", "parsely-author"))
    return F.when(~found.startswith("http"), found)


def published(html: Column) -> Column:
    return iso_date(F.coalesce(
        _structured(html, "$.datePublished", "$.dateCreated"), meta(html, "article:published_time", "datePublished", "date", "pubdate"),
        _blank(F.regexp_extract(html, r"""(?is)<time\b[^>]*datetime\s*=\s*["']([^"']*)["']""", 1)),
    ))


def language(html: Column) -> Column:
    """Primary subtag of the declared language."""
    tag = _blank(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z_-]+)""", 1))
    found = F.coalesce(tag, _structured(html, "$.inLanguage"), meta(html, "og:locale", "language"))
    return F.element_at(F.split(F.lower(F.trim(found)), "[-_]"), 1)


def text_of(html: Column) -> Column:
    """Visible text of the body."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def link_texts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1))


def link_share(html: Column) -> Column:
    """Share of the visible signs that stand in links; 0 for a page without text."""
    linked = F.aggregate(link_texts(html), F.lit(0), lambda s, t: s + F.length(F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))))
    total = F.length(text_of(html))
    return F.when(total > 0, linked / total).otherwise(0.0)


def page_type(words: Column, share: Column, n_links: Column, n_videos: Column, transcript: Column) -> Column:
    """video, article, listing or other."""
    return (
        F.when((n_videos > 0) & transcript, "video")
        .when((words >= MIN_ARTICLE_WORDS) & (share < MAX_LINK_SHARE), "article")
        .when(n_videos > 0, "video").when(n_links >= LISTING_LINKS, "listing").otherwise("other")
    )


def page_kind(kind: Column, url: Column, start: Column, depth: Column, words: Column, no_captions: Column) -> Column:
    """The type for one source: its start page and archive pages are listings; a
    long video page whose talks have no captions is an article."""
    same = F.regexp_replace(url, "/+$", "") == F.regexp_replace(start, "/+$", "")
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return (
        F.when((kind == "video") & no_captions & (words >= MIN_ARTICLE_WORDS), "article")
        .when((kind == "article") & (depth >= 1) & F.coalesce(same, F.lit(False)), "listing")
        .when((kind == "article") & path.rlike(LISTING_PATH), "listing").otherwise(kind)
    )

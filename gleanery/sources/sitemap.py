"""Sitemaps: locations with dates, and child maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_sitemaps(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, kind (page or child), loc, lastmod."""
    entry = r"(?is)<(?:\w+:)?(url|sitemap)\b[^>]*>(.*?)</(?:\w+:)?(?:url|sitemap)>"
    rows = files.select(key, F.explode(F.regexp_extract_all(text, F.lit(entry), F.lit(0))).alias("e"))
    return rows.select(
        key,
        F.when(F.lower(F.regexp_extract("e", r"^<(?:\w+:)?(\w+)", 1)) == "url", "page").otherwise("child").alias("kind"),
        F.trim(F.regexp_extract("e", r"(?is)<(?:\w+:)?loc>(.*?)</", 1)).alias("loc"),
        F.nullif(F.trim(F.regexp_extract("e", r"(?is)<(?:\w+:)?lastmod>(.*?)</", 1)), F.lit("")).alias("lastmod"),
    ).where("loc <> ''")

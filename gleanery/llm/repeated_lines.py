"""Lines that come back page after page within one source.

Every page gets a number inside its source, dense within the hash buckets that
the shuffle spreads pages over, which also splits hot sources. The pages of a line are a compressed bitmap: 64-page words keyed by
their number, of which only those with a page are stored, so a line on eight
pages takes at most eight words and a line on all pages one word for 64 pages.
Lines that differ in case, digits or spacing are variants; each variant has its
own bitmap and the variants' bitmaps are united by OR of their words. The exact
cardinality of the union is compared with the threshold, and lines are deleted
by looking up their page's bit.

Only line keys with at least ``min_pages`` occurrences reach the bitmap stage.
Distinct pages can never exceed occurrences, so that filter loses nothing; it
is a map-side combined count, sent to the lines behind a size check or else
salted. Bitmap words are formed where the lines are read and shuffled by line
and page word, so neither a hot source nor a line on all of its pages is
gathered anywhere: a key holds 64 pages.

Defined results: pages with null or blank source, null raw_path or null html
have no lines; redelivered pages count once; lines without visible text never
count; a line repeated within one page counts that page once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.html_lines import line_key, visible_lines
from gleanery.operators.joins import join_small
from gleanery.session import cut_lineage

MIN_PAGES = 8
WORD_BITS = 64

_PARSED = T.StructType(
    [
        T.StructField("raw_path", T.StringType()),
        T.StructField("line_no", T.ArrayType(T.IntegerType())),
        T.StructField("visible", T.ArrayType(T.StringType())),
        T.StructField("line_text", T.ArrayType(T.StringType())),
    ]
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, page in zip(pdf["raw_path"], pdf["html"]):
            lines = [(i, v) for i, v in enumerate(visible_lines(page), 1) if v]
            out.append((path, [i for i, _ in lines], [v for _, v in lines], [line_key(v) for _, v in lines]))
        yield pd.DataFrame(out, columns=_PARSED.names)


def fetched_pages(web_pages: DataFrame) -> DataFrame:
    """Distinct pages: doc_id, normalised source and raw path."""
    return (
        web_pages.select(
            "doc_id",
            F.lower(F.btrim("source_id", F.lit(" \t\n\r\xa0"))).alias("source"),
            "raw_path",
        )
        .where(F.col("doc_id").isNotNull() & F.col("raw_path").isNotNull() & (F.col("source") != ""))
    )


def page_lines(web_pages: DataFrame, web_raw: DataFrame) -> DataFrame:
    """doc_id, source, word, bit and the page's hashed lines as one array.

    Pages are parsed where they are read; only line hashes are shuffled."""
    parsed = (
        web_raw.select("raw_path", "html")
        .where(F.col("html").isNotNull() & F.col("raw_path").isNotNull())
        .mapInPandas(_parse, _PARSED)
        .select(
            "raw_path",
            F.zip_with(
                "line_no",
                F.zip_with("line_text", "visible", lambda k, v: F.struct(F.xxhash64(k).alias("norm"), F.xxhash64(v).alias("variant"))),
                lambda n, h: F.struct(n.alias("line_no"), h["norm"].alias("norm"), h["variant"].alias("variant")),
            ).alias("lines"),
        )
    )
    # pages that the join below brings to one partition share bitmap words, so
    # the words of a line are mostly complete before they are shuffled
    n_buckets = int(web_pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        fetched_pages(web_pages)
        .groupBy("source", "doc_id").agg(F.collect_set("raw_path").alias("paths"))
        .withColumn("bucket", F.pmod(F.hash(F.array_min("paths")), F.lit(n_buckets)))
        .withColumn("pos", F.expr("row_number() OVER (PARTITION BY source, bucket ORDER BY doc_id) - 1"))
        .select(
            "doc_id", "source", F.explode("paths").alias("raw_path"),
            (F.expr(f"pos div {WORD_BITS}") * n_buckets + F.col("bucket")).alias("word"),
            (F.col("pos") % WORD_BITS).cast("int").alias("bit"),
        )
    )
    return numbered.join(parsed, "raw_path").drop("raw_path")


def line_bitmaps(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """source, norm, word, bits, n_pages of the lines on at least ``min_pages``
    distinct pages of the source."""
    frequent = cut_lineage(
        lines.groupBy("source", "norm").agg(F.count(F.lit(1)).alias("n_seen")).where(F.col("n_seen") >= min_pages).select("source", "norm")
    )
    variants = (
        join_small(lines, frequent, ["source", "norm"], F.struct("word", "bit"))
        .groupBy("source", "norm", "variant", "word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )
    united = variants.groupBy("source", "norm", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    enough = (
        united.groupBy("source", "norm")
        .agg(F.sum(F.bit_count("bits")).alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    return united.join(enough, ["source", "norm"])


def repeated_lines(web_pages: DataFrame, web_raw: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, line_no, source, n_pages of every repeated line occurrence."""
    lines = cut_lineage(page_lines(web_pages, web_raw)).select(
        "doc_id", "source", "word", "bit", F.inline("lines")
    )
    bitmaps = line_bitmaps(lines, min_pages)
    return (
        lines.join(bitmaps, ["source", "norm", "word"])
        .where(F.expr("shiftright(bits, bit) & 1L") == 1)
        .select("doc_id", "line_no", "source", "n_pages")
        .distinct()
    )


_CLEAN = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, page, drop in zip(pdf["doc_id"], pdf["html"], pdf["drop_lines"]):
            gone = set() if drop is None else set(int(x) for x in drop)
            lines = [(i, v) for i, v in enumerate(visible_lines(page), 1) if v]
            kept = [v for i, v in lines if i not in gone]
            out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
        yield pd.DataFrame(out, columns=_CLEAN.names)


def pages_without_repeats(web_pages: DataFrame, web_raw: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Each page's visible text without the lines its source repeats."""
    drop = (
        repeated_lines(web_pages, web_raw, min_pages)
        .groupBy("doc_id")
        .agg(F.collect_set("line_no").alias("drop_lines"))
    )
    # the line numbers travel to the page, so the raw text moves once at most
    pages = fetched_pages(web_pages).select("doc_id", "raw_path").distinct().join(drop, "doc_id", "left")
    return (
        web_raw.select("raw_path", "html").join(pages, "raw_path")
        .select("doc_id", "html", "drop_lines")
        .mapInPandas(_strip, _CLEAN)
    )

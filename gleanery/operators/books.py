"""Books: repaired words and detected chapters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import books as bk

# fixed values
MIN_CHAPTERS, MAX_SHARE, WINDOW_PAGES, HEAD_SLACK, FOUND_SHARE = 3, 0.6, 15, 12, 0.6
MAX_SUSPECTS, MIN_LOWER = 2, 3
_SUSPECT = r"[@&%+=#<>^~|*$0-9]|(?<=.)[A-Z]"


def repair_ligatures(words: DataFrame, core: str, vocab: DataFrame) -> DataFrame:
    """core, fixed: the most frequent word of ``vocab`` (word, n) that a damaged word
    spells when each of its at most two suspect signs is a ligature.

    The vocabulary is damaged in the same way, so both meet in an equi-join on
    the word without its ligatures; nothing is sent to the workers."""
    marked = F.regexp_replace(core, _SUSPECT, "@")
    n_suspects = F.length(marked) - F.length(F.replace(marked, F.lit("@"), F.lit("")))
    lower = F.length(F.regexp_replace(core, "[^a-z]", ""))
    capitals = ~F.regexp_replace(core, "(?<=.)[A-Z]", "").rlike("[^A-Za-z]")
    asked = words.select(core, F.lower(marked).alias("k"), n_suspects.alias("s"), lower.alias("low"), capitals.alias("caps")).where(
        F.col("s").between(1, MAX_SUSPECTS) & (F.col("low") > 0) & ((F.col("low") >= MIN_LOWER) | F.col("caps"))
    )
    known = vocab.where(F.col("word").rlike("ff|fi|fl")).select("word", "n", _spellings(F.col("word")).alias("ks")).select("word", "n", F.explode("ks").alias("k"))
    order = Window.partitionBy(core).orderBy(F.desc("n"), F.desc("word"))
    return asked.join(known, "k").withColumn("rn", F.row_number().over(order)).where("rn = 1").select(core, F.col("word").alias("fixed"))


def _spellings(word: Column) -> Column:
    """The word with one or two of its ligatures as suspect signs."""
    longest = F.regexp_replace(word, "ffi|ffl|ff|fi|fl", "@")
    first = F.regexp_replace(word, "^(.*?)(?:ffi|ffl|ff|fi|fl)", "$1@")
    last = F.regexp_replace(word, "^(.*)(?:ffi|ffl|(?<!f)ff|(?<!f)fi|(?<!f)fl)", "$1@")
    return F.array_distinct(F.array(longest, first, last))


def page_windows(paragraphs: DataFrame) -> DataFrame:
    """book, title, page: windows of fifteen pages from the first to the last."""
    ends = paragraphs.groupBy("book").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    return ends.select("book", "hi", F.explode(F.sequence("lo", "hi", F.lit(WINDOW_PAGES))).alias("page")).select(
        "book", F.format_string("Pages %d-%d", "page", F.least(F.col("page") + WINDOW_PAGES - 1, F.col("hi"))).alias("title"), "page"
    )


def align_contents(entries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """book, title, page: contents entries found, in order, at the opening of a
    later page; no row for books where too few are found.

    ``entries`` has book, no, title, contents_page; ``paragraphs`` book, page,
    pos, text. Each entry is sought after the page of the one before it, so a
    book's two short lists are merged in one task."""
    first = Window.partitionBy("book", "page").orderBy("pos")
    openings = paragraphs.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(
        "book", F.struct("page", F.substring(bk.compact(F.col("text")), 1, 120).alias("head")).alias("o")
    ).groupBy("book").agg(F.array_sort(F.collect_list("o")).alias("openings"))
    wanted = entries.select("book", "contents_page", F.struct(
        "no", "title", bk.compact(F.col("title")).alias("key"), bk.compact(bk.plain(F.col("title"))).alias("alt"),
        (~bk.is_matter(F.col("title")) & ~F.col("title").rlike(bk.PART)).alias("body"),
    ).alias("e")).groupBy("book").agg(F.array_sort(F.collect_list("e")).alias("entries"), F.max("contents_page").alias("after"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for book, after, entries_, openings_ in zip(pdf["book"], pdf["after"], pdf["entries"], pdf["openings"]):
                pages = [(o["page"], o["head"]) for o in openings_ if o["page"] > after]
                at, found = 0, []
                for e in entries_:
                    if len(e["alt"]) < 3:
                        continue
                    keys = [e["key"]] + ([e["alt"]] if e["key"] != e["alt"] or len(e["alt"]) >= 8 else [])
                    hit = next((i for i in range(at, len(pages)) if any(0 <= pages[i][1].find(k) <= HEAD_SLACK for k in keys)), None)
                    if hit is not None:
                        found.append((book, e["title"], pages[hit][0], bool(e["body"])))
                        at = hit + 1
                n_body, n_found = sum(bool(e["body"]) for e in entries_), sum(f[3] for f in found)
                if n_body >= MIN_CHAPTERS and n_found >= max(MIN_CHAPTERS, FOUND_SHARE * n_body):
                    rows += [f[:3] for f in found]
            yield pd.DataFrame(rows, columns=["book", "title", "page"])

    kind = dict(entries.dtypes)["book"]
    return wanted.join(openings, "book").mapInPandas(merge, f"book {kind}, title string, page long")


def numbered_headings(paragraphs: DataFrame) -> DataFrame:
    """book, title, page of the numbered headings where 3 to 80 are chapters, with
    the front and back matter that bounds them."""
    heads = paragraphs.where("kind = 'heading'").withColumn("matter", bk.is_matter(F.col("text"))).withColumn("numbered", F.col("text").rlike(bk.NUMBERING))
    n = F.count(F.when(F.col("numbered") & ~F.col("matter"), 1)).over(Window.partitionBy("book"))
    return heads.withColumn("n", n).where((F.col("n").between(MIN_CHAPTERS, 80)) & (F.col("numbered") | F.col("matter"))).select("book", F.col("text").alias("title"), "page")


def chapters(candidates: DataFrame, paragraphs: DataFrame, min_words: int = 60) -> DataFrame:
    """book, title, page, n_words: the text from each candidate to the next one is its
    chapter; matter, parts and pieces of under ``min_words`` words are none."""
    order = Window.partitionBy("book").orderBy("page", "title")
    spans = candidates.withColumn("next", F.lead("page").over(order))
    words = paragraphs.groupBy("book", "page").agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("w")).withColumnRenamed("page", "at")
    sized = (
        spans.join(words, "book").where((F.col("at") >= F.col("page")) & (F.col("next").isNull() | (F.col("at") < F.col("next"))))
        .groupBy("book", "title", "page").agg(F.sum("w").alias("n_words"))
    )
    return sized.where(~bk.is_matter(F.col("title")) & ~F.col("title").rlike(bk.PART) & (F.col("n_words") >= min_words)).withColumn("title", bk.plain(F.col("title")))


def detect_chapters(sources: list[tuple[str, DataFrame]], paragraphs: DataFrame) -> DataFrame:
    """book, method, title, page, n_words from the first source with a plausible
    split: three chapters or more, none with over 60 % of the words; page windows
    are taken where no source has one.

    ``sources`` are (name, candidates) from the most to the least trusted."""
    tried = None
    for rank, (name, found) in enumerate([*sources, ("windows", page_windows(paragraphs))]):
        one = chapters(found, paragraphs, 0 if name == "windows" else 60).withColumn("method", F.lit(name)).withColumn("rank", F.lit(rank))
        tried = one if tried is None else tried.unionByName(one)
    last = len(sources)
    plan = Window.partitionBy("book", "rank")
    fits = (F.col("rank") == last) | ((F.col("n") >= MIN_CHAPTERS) & (F.col("most") <= MAX_SHARE * F.col("total")))
    good = (
        tried.withColumn("n", F.count(F.lit(1)).over(plan)).withColumn("most", F.max("n_words").over(plan)).withColumn("total", F.sum("n_words").over(plan))
        .where(fits).withColumn("best", F.min("rank").over(Window.partitionBy("book")))
    )
    return good.where(F.col("rank") == F.col("best")).select("book", "method", "title", "page", "n_words")

"""Quotes grounded in the text they are said to come from.

A quote is compared with every window of its own length in the text, by set
similarity; a tidied quote of enough distinct words may instead be contained in
a somewhat longer window. Both measures need, for every window, how many
distinct words it has and how many of them are the quote's. A word is counted
once in a window if its previous occurrence lies before the window, so each
place of the text adds one to an interval of window starts; summing the
intervals gives all windows of a size in linear time.

Defined results: null or wordless quotes and texts score 0 at no place; a text
shorter than the window is one window; ties go to the earliest window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import FILLERS

# fixed values
MIN_JACCARD = 0.70
MIN_CONTAINMENT = 0.90
CONTAINMENT_MIN_WORDS = 8
WINDOW_SCALES = (1.15, 1.3, 1.5)
MIN_WINDOW = 4
MIN_PIECE_WORDS = 4
PASS_RATE, FAIL_RATE = 0.90, 0.60
ISSUE_MIN_WORDS = 1000
NARRATIVE = ("ai-and-tech-trends", "founder-story", "other")

_NOTE = re.compile(r"\[[^\]]{0,40}\]|\(\s*[^()\s]+(?:\s+[^()\s]+){0,2}\s*\)")
_OTHER = re.compile(r"[^a-z0-9' ]+")
_ELLIPSIS = re.compile(r"\[\s*\.\.\.\s*\]|\.{3,}|…")
_SKIP = frozenset(FILLERS)


def quote_words(text: str | None) -> list[str]:
    """Comparable words: short bracketed notes, other signs and fillers dropped."""
    bare = _OTHER.sub(" ", _NOTE.sub(" ", (text or "").lower()))
    return [w for w in bare.split() if w not in _SKIP]


class Text:
    """A text's words as numbers, with the previous place of each."""

    def __init__(self, words: list[str]):
        self.number: dict[str, int] = {}
        self.codes = np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), np.int64, len(words))
        last = np.full(len(self.number), -1, np.int64)
        self.before = np.empty(len(words), np.int64)
        for i, c in enumerate(self.codes.tolist()):
            self.before[i], last[c] = last[c], i

    def distinct(self, size: int, chosen: np.ndarray | None = None) -> np.ndarray:
        """Distinct words of every window of ``size``, of the chosen places only."""
        n = len(self.codes)
        starts = max(1, n - size + 1)
        at = np.arange(n) if chosen is None else chosen
        low = np.maximum(np.maximum(self.before[at] + 1, at - size + 1), 0)
        high = np.minimum(at, starts - 1)
        real = low <= high
        change = np.bincount(low[real], minlength=starts + 1) - np.bincount(high[real] + 1, minlength=starts + 1)
        return np.cumsum(change)[:starts]

    def best(self, quote: list[str], least: float = MIN_JACCARD) -> tuple[float, int, bool]:
        """Score, place and acceptance of a quote's words."""
        if not quote or not len(self.codes):
            return 0.0, -1, False
        wanted = set(quote)
        known = np.array([self.number[w] for w in wanted if w in self.number], np.int64)
        if not len(known):
            return 0.0, -1, False
        mine = np.flatnonzero(np.isin(self.codes, known))
        size = max(len(quote), MIN_WINDOW)
        shared = self.distinct(size, mine)
        score = shared / (len(wanted) + self.distinct(size) - shared)
        place = int(np.argmax(score))
        found = (float(score[place]), place, bool(score[place] >= least))
        if found[2] or len(wanted) < CONTAINMENT_MIN_WORDS:
            return found
        held = (0.0, -1)
        for scale in WINDOW_SCALES:
            share = self.distinct(int(round(len(quote) * scale)), mine) / len(wanted)
            place = int(np.argmax(share))
            if share[place] > held[0]:
                held = (float(share[place]), place)
        return (*held, True) if held[0] >= MIN_CONTAINMENT else found


def find_quote(quote: str | None, text: Text, least: float = MIN_JACCARD) -> tuple[float, int, bool]:
    """A quote joined by ellipses is as good as its weakest piece and stands where
    its first piece stands; every piece must be found."""
    pieces = [p for p in map(quote_words, _ELLIPSIS.split(quote or "")) if len(p) >= MIN_PIECE_WORDS]
    pieces = pieces or [p for p in [quote_words(quote)] if p]
    found = [text.best(p, least) for p in pieces]
    if not found:
        return 0.0, -1, False
    return min(f[0] for f in found), found[0][1], all(f[2] for f in found)


def ground_quotes(rows: DataFrame, key: str, quote: str, text: str, least: float = MIN_JACCARD) -> DataFrame:
    """key, score, at (word of the text, from 0; null where nothing fits), ok."""
    kind = dict(rows.dtypes)[key]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [find_quote(q, Text(quote_words(t)), least) for q, t in zip(pdf["q"], pdf["t"])]
            yield pd.DataFrame(
                {
                    key: pdf[key], "score": [f[0] for f in found],
                    "at": pd.array([f[1] if f[1] >= 0 else None for f in found], "Int64"), "ok": [f[2] for f in found],
                }
            )

    return rows.select(key, F.col(quote).alias("q"), F.col(text).alias("t")).mapInPandas(
        score, f"{key} {kind}, score double, at long, ok boolean"
    )


def roll_up(checked: DataFrame, doc: str, issues: Column) -> DataFrame:
    """doc, checked, failed, pass_rate, status: pass from 0.90 on, failed under
    0.60, else flagged; issues flag what would pass; nothing checked is 1.0.

    ``checked`` has one row per document and quote, ``ok`` null where the
    document has none."""
    return (
        checked.groupBy(doc)
        .agg(F.count("ok").alias("checked"), F.count_if(~F.col("ok")).alias("failed"), F.bool_or(F.coalesce(issues, F.lit(False))).alias("issue"))
        .withColumn("pass_rate", F.when(F.col("checked") == 0, 1.0).otherwise((F.col("checked") - F.col("failed")) / F.col("checked")))
        .withColumn(
            "status",
            F.when(F.col("pass_rate") < FAIL_RATE, "failed")
            .when((F.col("pass_rate") < PASS_RATE) | F.col("issue"), "flagged").otherwise("pass"),
        )
    )


def record_issue(n_words: Column, n_items: Column, n_advice: Column, category: Column, neutral: Column) -> Column:
    """What the pass rate cannot see: a long text that gave nothing, or no advice
    though it is neither narrative nor neutral; null without a fault."""
    long = n_words >= ISSUE_MIN_WORDS
    return F.when(long & (n_items == 0), "nothing").when(
        long & (n_advice == 0) & ~F.coalesce(neutral, F.lit(False)) & ~F.coalesce(category.isin(*NARRATIVE), F.lit(False)), "no advice"
    )

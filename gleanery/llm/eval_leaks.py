"""Evaluation passages inside training documents.

Pigeonhole edit matching over words. A passage is any run of ``PASSAGE`` words
of a test item, with an error budget of ``BUDGET`` words. A passage is split into
BUDGET + 1 pieces of ``PASSAGE // (BUDGET + 1)`` words, and with at most BUDGET
errors it keeps one of them intact. Passages start anywhere, so the pieces at
every offset of an item are indexed. Exact piece hits come from an
Aho-Corasick scan of each whole document; every hit is verified with Myers'
bit-parallel distance between the item's passages around the piece and the
document's words around the hit.

The test set is the stated query set; it is split into blocks of at most
``ITEMS_PER_BLOCK`` items and each block meets all documents in one scan, so
what is sent to the workers is bounded whatever the set's size.

Defined results: null or wordless texts match nothing; items shorter than a
passage cannot leak; a pair is reported once however often the item occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 12
BUDGET = 1
ITEMS_PER_BLOCK = 20_000

_WORD = re.compile(r"[a-z0-9']+")
_KEEP = b"abcdefghijklmnopqrstuvwxyz0123456789'"
_BLANKED = bytes(b if b in _KEEP else 32 for b in range(256))


def canonical(text: str) -> str:
    """Words of the lower-cased text, one blank around each."""
    words = text.lower().encode("utf-8", "replace").translate(_BLANKED).split()
    return f" {b' '.join(words).decode('ascii')} "


def myers(pattern: list[str], text: list[str]) -> int:
    """Least number of word edits that turn ``pattern`` into some stretch of
    ``text`` (bit-parallel, one machine word per text word)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = score
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | (~(xv | ph) & mask)) & mask
        mv = ph & xv
        best = min(best, score)
    return best


class Matcher:
    """Piece automaton and verification for one block of items."""

    def __init__(self, items: list[tuple[int, str]], passage: int = PASSAGE, budget: int = BUDGET):
        self.passage, self.budget = passage, budget
        self.piece = passage // (budget + 1)
        self.items = {i: _WORD.findall((t or "").lower()) for i, t in items}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, words in self.items.items():
            if len(words) < passage:
                continue
            for p in range(len(words) - self.piece + 1):
                key = f" {' '.join(words[p:p + self.piece])} "
                found.setdefault(key, []).append((i, p))
        self.automaton = ahocorasick.Automaton()
        for key, where in found.items():
            self.automaton.add_word(key, (len(key), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def distances(self, text: str) -> dict[int, int]:
        """Least passage distance per item within the error budget."""
        out: dict[int, int] = {}
        if self.empty or not text:
            return out
        for end, (size, where) in self.automaton.iter(text):
            start = end - size + 1
            for item, p in where:
                if out.get(item) == 0:
                    continue
                d = self._verify(text, start, self.items[item], p)
                if d <= self.budget and d < out.get(item, self.budget + 1):
                    out[item] = d
        return out

    def _verify(self, text: str, at: int, words: list[str], p: int) -> int:
        first, last = at, at
        for _ in range(self.passage - self.piece + self.budget):
            first = text.rfind(" ", 0, first)
            if first <= 0:
                first = 0
                break
        for _ in range(self.passage + self.budget):
            last = text.find(" ", last + 1)
            if last < 0:
                last = len(text)
                break
        left, right = text[first:at].split(), text[at:last].split()
        around, mid = left + right, len(left)
        best = self.passage
        for s in range(max(0, p + self.piece - self.passage), min(p, len(words) - self.passage) + 1):
            lo = max(0, mid - (p - s) - self.budget)
            best = min(
                best,
                myers(words[s:s + self.passage], around[lo: mid - (p - s) + self.passage + self.budget]),
            )
            if best == 0:
                break
        return best


_HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("distance", T.IntegerType()),
    ]
)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance (0 = a passage word by word)."""
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    # an item has a piece at every offset; the automaton stays as large as one of
    # ITEMS_PER_BLOCK items cut piece by piece
    n_blocks = max(1, -(-items.count() * (PASSAGE // (BUDGET + 1)) // ITEMS_PER_BLOCK))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    out = None
    for b in range(n_blocks):
        block = [
            (r["item_id"], r["text"])
            for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()
        ]

        def scan(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            matcher = Matcher(block)
            for pdf in batches:
                rows = [
                    (doc, item, d)
                    for doc, text in zip(pdf["doc_id"], pdf["text"])
                    for item, d in matcher.distances(canonical(text)).items()
                ]
                yield pd.DataFrame(rows, columns=_HITS.names)

        hits = texts.mapInPandas(scan, _HITS)
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))

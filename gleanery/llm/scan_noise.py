"""Noise in the text of scanned books: faulty lines and repaired paragraphs.

Page furniture and unreadable lines are found per book from the lines
themselves. The rest is running text, decoded by a noisy channel: the
probability that a character was read as another, times the likelihood of the
words under unigram and bigram counts of all books' running text, maximised
over the candidate words of each line by Viterbi. A line whose best path
changes a word is misread. Words broken at a line end are joined with or
without their hyphen, whichever form the corpus prefers.

Candidates are found by a skeleton that every confusion leaves as it is, so a
word meets all words it may stand for, with any number of confusions, in one
equi-join; the pair is then aligned. The probabilities of the confusions start
equal and are estimated by Viterbi training: all doubtful lines are decoded,
the confusions on their best paths counted, and the lines decoded again.

Corpus counts are map-side combined; candidates meet their counts by joins on
the words, and only lines with a doubtful word are decoded, so nothing grows
in one task or on the driver but the edge pages of one book.

Defined results: null or empty pages, null labels and null meta are no fault;
redelivered books count once; of different books of one path the one of
greatest sha256, then of greatest content, counts; a garbled or furniture line
has no other fault; without a continuation (the next page is not kept) a broken
word is judged by the forms of the corpus that begin with its first part.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.session import cut_lineage, written

#: Character confusions of text recognition, true -> read (fixed values).
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("o", "0"), ("l", "1"), ("i", "l"), ("i", "1"), ("l", "i"), ("s", "5"),
    ("h", "b"), ("g", "9"), ("b", "6"), ("z", "2"), ("a", "4"), ("n", "ri"), ("d", "cl"), ("u", "ii"),
    ("m", "rn"), ("w", "vv"), ("rn", "m"), ("cl", "d"), ("c", "e"), ("b", "h"), ("f", "t"), ("m", "nn"),
    ("h", "li"), ("li", "h"),
)
LOG_KEEP = math.log(0.99)
#: Probability of each confusion before any is counted, and the occurrences it
#: stands for among those counted.
CONFUSED, CONFUSED_WEIGHT = 4e-4, 20_000
ROUNDS = 2
#: Words whose letter likelihood a worker remembers.
MEMO_WORDS = 200_000
#: Similarity of two forms of one running line.
LIKE = 0.86
#: Doubtful words up to which they are sent to the lines.
BROADCAST_WORDS = 200_000
#: A candidate must be this many times as frequent as the word as read.
FREQUENT = 5
BIGRAM_SHARE = 0.7
#: Mean letter-pair bits below which a line is no text.
GARBLED_BITS = -5.0

HYPHENS = "-‐‑¬­"
_TRIM = re.compile(r"^[\s·•|/\[\](){}<>*~_.,:;—–\-]+|[\s·•|/\[\](){}<>*~_.,:;—–\-]+$")
_NUMBER_LINE = re.compile(
    r"^[\W_]*(?:(?:p|pg|page|seite|s)\b\.?)?[\W_]*((?:[0-9oOlIiSsBZ] ?){1,5}|(?:[ivxlcdmIVXLCDM1] ?){1,9})[\W_]*$"
)
_ROMAN = re.compile(r"^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-‐‑][^\W_]+)*")
#: Signs that belong to no text.
_ODD = re.compile(r"[^\w\s.,;:?!'\"’‘“”()\-–—…&/%‐¬\u00ad·|\[\]]|_")
_CHAPTER = re.compile(r"^\s*(?:chapter|part|kapitel|chapitre)\s+\w+\s*$", re.I)
_END_MARK = re.compile(r"[.?!:;,\"”’)]$")
_LOOKS = str.maketrans("0158961", "oisbgbi")


class Letters:
    """Letter-pair likelihood of the corpus: bounded by the alphabet."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        after: dict[str, int] = {}
        for (a, _), n in counts.items():
            after[a] = after.get(a, 0) + n
        self.bits = {(a, b): math.log2((n + 0.5) / (after[a] + 14)) for (a, b), n in counts.items()}
        self.unseen = {a: math.log2(0.5 / (n + 14)) for a, n in after.items()}
        self.memo: dict[str, float] = {}

    def word_bits(self, word: str) -> float:
        w = f" {word} "
        return sum(self.bits.get((a, b), self.unseen.get(a, -5.0)) for a, b in zip(w, w[1:]))

    def mean_bits(self, line: str) -> float:
        """Mean log probability of the line's letter pairs, 0 for short lines."""
        words = re.findall(r"[a-z]+", line.lower())
        n = sum(map(len, words)) + len(words)
        if n < 8:
            return 0.0
        total = 0.0
        for w in words:
            if w not in self.memo:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[w] = self.word_bits(w)
            total += self.memo[w]
        return total / n


_LETTER = np.zeros(256, np.int64)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = np.arange(1, 27)


def letter_model(pdf_facts: DataFrame) -> Letters:
    """Counts of letter pairs over all lines, a blank around each word; at most
    27 x 27 rows leave Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            text = "\n".join(filter(None, batch.column("t").to_pylist())).encode("utf-8", "replace")
            code = _LETTER[np.frombuffer(b"\n" + text + b"\n", np.uint8)]
            total += np.bincount(code[:-1] * 27 + code[1:], minlength=27 * 27)
        total[0] = 0  # between two blanks
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pair", "n"])

    texts = pdf_facts.where("edge_pages IS NOT NULL").select(
        F.explode(F.transform(F.map_values(F.map_filter("edge_pages", lambda k, v: v.isNotNull())), lambda ls: F.array_join(ls, "\n"))).alias("t")
    )
    pairs = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    signs = " abcdefghijklmnopqrstuvwxyz"
    return Letters({(signs[r["pair"] // 27], signs[r["pair"] % 27]): r["n"] for r in pairs.collect()})


def is_garbled(line: str, letters_of: Letters | None = None) -> bool:
    """A line most of whose signs belong to no text, or whose letters follow
    each other as in no text of the corpus."""
    if letters_of is not None and letters_of.mean_bits(line) < GARBLED_BITS:
        return True
    signs = len("".join(line.split()))
    if signs < 4:
        return False
    odd = len(_ODD.findall(line))
    if odd >= 0.2 * signs:
        return True
    return odd >= 3 and sum(map(str.isalpha, line)) < 0.4 * signs


def page_number(line: str, labels: set[str]) -> bool:
    """The line is nothing but a page number, in any dress."""
    m = _NUMBER_LINE.match(line)
    if not m:
        return False
    core = m.group(1).replace(" ", "").lower()
    if core in labels or re.fullmatch(r"[0-9]{1,4}", core):
        return True
    digits = core.translate(str.maketrans("oliszb", "011526"))
    return bool(re.search(r"\d", core) and re.fullmatch(r"\d{1,4}", digits)) or digits in labels or bool(
        _ROMAN.match(core.replace("1", "i"))
    )


def _core(text: str) -> str:
    """Comparable form of a heading: no page number, case or look-alikes."""
    t = _TRIM.sub("", text)
    t = re.sub(r"^(?:\d{1,4}|[ivxlc]{1,7})\s{2,}|\s{2,}(?:\d{1,4}|[ivxlc]{1,7})$", "", t, flags=re.I)
    t = re.sub(r"\s[-–—|/·]\s*(?:p\.?\s*)?(?:\d{1,4}|[ivxlc]{1,7})$|^(?:\d{1,4}|[ivxlc]{1,7})\s*[-–—|/·]\s", "", t, flags=re.I)
    return re.sub(r"[^a-z ]+", "", t.lower().translate(_LOOKS).replace("vv", "w").replace("rn", "m")).strip()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _like(a: str, b: str) -> bool:
    """Forms of one line: matching blocks of at least ``LIKE`` of both. Blocks
    are never longer than the common subsequence, which is found faster."""
    if not a or not b:
        return False
    if a == b:
        return True
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) or 2 * _common(a, b) < LIKE * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= LIKE


class _Alike:
    """Which of a book's strings are forms of one line."""

    def __init__(self, strings: list[str]):
        self.strings = list(dict.fromkeys(strings))
        self.size = np.array([len(s) for s in self.strings])
        letters = "abcdefghijklmnopqrstuvwxyz "
        self.counts = np.array([[s.count(c) for c in letters] for s in self.strings]).reshape(-1, len(letters))
        self.found: dict[str, list[str]] = {}

    def of(self, a: str) -> list[str]:
        if a not in self.found:
            mine = np.array([a.count(c) for c in "abcdefghijklmnopqrstuvwxyz "])
            shared = np.minimum(self.counts, mine).sum(axis=1)
            near = np.flatnonzero(2 * shared >= LIKE * (self.size + len(a)))
            self.found[a] = [self.strings[i] for i in near if _like(a, self.strings[i])]
        return self.found[a]


def _parts(line: str) -> list[str]:
    parts = [_core(line)] + [_core(p) for p in re.split(r"\s+[/|·•–—-]\s+|\s{2,}", line)]
    return [p for p in dict.fromkeys(parts) if len(p) >= 6]


class Book:
    """Line kinds of one book's edge pages."""

    def __init__(
        self, pages: dict[int, list[str]], labels: dict[int, str] | None, meta: str | None, letters: Letters | None = None
    ):
        self.pages = {p: list(ls) if ls is not None else [] for p, ls in sorted((pages or {}).items())}
        self.labels = {p: (v or "").strip().lower() for p, v in (labels or {}).items()}
        self.kind = {(p, i): "blank" if not (t or "").strip() else "body" for p, ls in self.pages.items() for i, t in enumerate(ls)}
        lengths = sorted(len(t) for ls in self.pages.values() for t in ls if t)
        self.width = lengths[int(0.95 * (len(lengths) - 1))] if lengths else 0
        titles = []
        try:
            title = json.loads(meta or "null")
            if isinstance(title, dict) and isinstance(title.get("title"), str):
                titles.append(title["title"])
        except ValueError:
            pass
        for p, ls in self.pages.items():
            rows = [i for i, t in enumerate(ls) if (t or "").strip()]
            if not rows:
                continue
            if len(rows) <= 6 and p == min(self.pages) and any(re.search(r"\b(1[5-9]|20)\d\d\b", ls[i]) for i in rows):
                for i in rows:
                    if not page_number(ls[i], self._label(p)):
                        self.kind[p, i] = "heading"
                titles.append(ls[rows[0]])
            for k, i in enumerate(rows[:-1]):
                if _CHAPTER.match(ls[i]) and k <= 2:
                    self.kind[p, i] = self.kind[p, rows[k + 1]] = "heading"
                    titles.append(ls[rows[k + 1]])
            for i in rows:
                if self.kind[p, i] == "body" and is_garbled(ls[i], letters):
                    self.kind[p, i] = "garbled"
        self.titles = [c for c in (_core(t) for t in titles) if c]
        self._furniture()

    def _label(self, p: int) -> set[str]:
        return {x for x in (self.labels.get(p, ""), str(p)) if x}

    def _edges(self, p: int) -> list[int]:
        rows = [i for i, t in enumerate(self.pages[p]) if (t or "").strip()]
        return list(dict.fromkeys(rows[:2] + rows[-2:]))

    def _furniture(self) -> None:
        edge = {}
        for p in self.pages:
            for i in self._edges(p):
                if self.kind[p, i] in ("heading", "garbled"):
                    continue
                if page_number(self.pages[p][i], self._label(p)):
                    self.kind[p, i] = "furniture"
                else:
                    edge[p, i] = _parts(self.pages[p][i])
        where: dict[str, list[tuple[int, int]]] = {}
        for spot, parts in edge.items():
            for a in parts:
                where.setdefault(a, []).append(spot)
        alike = _Alike(list(where))
        for t in self.titles:
            for a in alike.of(t):
                for spot in where[a]:
                    self.kind[spot] = "furniture"
        for (p, i), parts in edge.items():
            if self.kind[p, i] == "furniture":
                continue
            twin = any(
                q != p and (self.kind[q, j] == "furniture" or not _END_MARK.search(self.pages[q][j].strip()))
                for a in parts for b in alike.of(a) for q, j in where[b]
            )
            text = self.pages[p][i].strip()
            rows = [j for j, t in enumerate(self.pages[p]) if (t or "").strip()]
            outer = {rows[1]: rows[0], rows[-2]: rows[-1]}.get(i) if len(rows) > 3 else None
            if outer is not None and self.kind[p, outer] != "furniture":
                continue
            if twin and not _END_MARK.search(text) and text[-1] not in HYPHENS:
                self.kind[p, i] = "furniture"
        for p in self.pages:
            rows = [i for i in range(len(self.pages[p])) if self.kind[p, i] != "blank"]
            body = [i for i in rows if self.kind[p, i] not in ("furniture", "garbled")]
            if body and self.kind[p, body[0]] == "body" and (body[0] == rows[0] or self.kind[p, rows[0]] == "furniture"):
                if body[0] in self._edges(p)[:2] and self._lone_header(p, body[0], body[1:]):
                    self.kind[p, body[0]] = "furniture"
            if body and self.kind[p, body[-1]] == "body" and body[-1] in rows[-2:]:
                if self._styled(self.pages[p][body[-1]]) and body[-1] == rows[-1]:
                    self.kind[p, body[-1]] = "furniture"

    def _styled(self, line: str) -> bool:
        """Set as a running line: ornaments, a page number of its own, or capitals."""
        t = line.strip()
        letters = [c for c in t if c.isalpha()]
        capitals = len(letters) >= 8 and sum(c.isupper() for c in letters) >= 0.85 * len(letters)
        numbered = re.search(r"^(?:\d{1,4}|[ivxlc]{1,7})\s{2,}\S|\S\s{2,}(?:\d{1,4}|[ivxlc]{1,7})$", t)
        return bool(capitals or numbered or (t[0] in "·•" and t[-1] in "·•") or re.search(r"\S\s+/\s+\S", t))

    def _lone_header(self, p: int, i: int, rest: list[int]) -> bool:
        """A running header that no other kept page repeats."""
        line = self.pages[p][i].strip()
        if self._styled(line):
            return True
        if _END_MARK.search(line) or line[-1] in HYPHENS or not (line[0].isupper() or line[0].isdigit()):
            return False
        if not rest:
            return False
        below = self.pages[p][rest[0]].strip()
        first = below.split(" ")[0]
        # running text would have taken the next line's first word
        if below and len(line) + 1 + len(first) <= self.width - 2:
            return True
        before = [j for j in range(len(self.pages.get(p - 1, []))) if self.kind[p - 1, j] == "body"]
        if not before:
            return False
        last = self.pages[p - 1][before[-1]].strip()
        open_before = last[-1] in HYPHENS or not re.search(r"[.?!\"”]$", last)
        return open_before and below[:1].islower() and not line[0].isdigit()

    def lines(self):
        """(page_no, line_no, kind, text, tokens, cont, broken, next_page, next_line)."""
        flow = [(p, i) for p in self.pages for i in range(len(self.pages[p])) if self.kind[p, i] == "body"]
        follower = {}
        for a, b in zip(flow, flow[1:]):
            if b[0] - a[0] <= 1:
                follower[a] = b
        continued = set()
        out = []
        for p, ls in self.pages.items():
            for i, t in enumerate(ls):
                kind, text = self.kind[p, i], (t or "").strip()
                tokens, broken, nxt = [], False, None
                if kind in ("body", "heading"):
                    broken = kind == "body" and len(text) > 1 and text[-1] in HYPHENS and text[-2].isalnum()
                    tokens = _TOKEN.findall(text.lower())
                    nxt = follower.get((p, i))
                    if broken and nxt is not None:
                        continued.add(nxt)
                out.append([p, i + 1, kind, text, tokens, False, broken, *(nxt if nxt else (None, None))])
        for row in out:
            row[5] = (row[0], row[1] - 1) in continued
            if row[8] is not None:
                row[8] += 1
        return out


_LINES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("cont", T.BooleanType()),
        T.StructField("broken", T.BooleanType()),
        T.StructField("next_page", T.IntegerType()),
        T.StructField("next_line", T.IntegerType()),
    ]
)


_ARROW = [
    pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(),
]


def _maps() -> list[Column]:
    """Hashable forms of a book's maps, for a fixed choice between books."""
    return [F.sort_array(F.map_entries(c)) for c in ("edge_pages", "page_labels")] + [F.col("meta")]


def book_lines(pdf_facts: DataFrame) -> DataFrame:
    """Every line of the edge pages with its kind and tokens."""
    books = (
        pdf_facts.where(F.col("path").isNotNull() & F.col("edge_pages").isNotNull())
        .groupBy("path")
        .agg(F.max_by(F.struct("edge_pages", "page_labels", "meta"), F.struct(F.coalesce("sha256", F.lit("")), F.xxhash64(*_maps()))).alias("b"))
        .select("path", "b.edge_pages", "b.page_labels", "b.meta")
    )
    letters = letter_model(pdf_facts)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _LINES.names]
            for path, pages, labels, meta in zip(*(c.to_pylist() for c in batch.columns)):
                lines = Book(dict(pages or ()), dict(labels or ()), meta, letters).lines()
                columns[0] += [path] * len(lines)
                for column, cells in zip(columns[1:], zip(*lines)):
                    column += cells
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=_LINES.names)

    return books.mapInArrow(classify, _LINES)


def _whole_tokens():
    """Tokens of a line without the pieces of broken words."""
    n = F.size("tokens")
    start = F.when(F.col("cont"), 2).otherwise(1)
    length = n - F.when(F.col("cont"), 1).otherwise(0) - F.when(F.col("broken"), 1).otherwise(0)
    return F.when(length > 0, F.slice("tokens", start, F.greatest(length, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )


def word_counts(lines: DataFrame) -> DataFrame:
    return (
        lines.where("kind = 'body'").select(F.explode(_whole_tokens()).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def pair_counts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, b, n_ab of the wanted pairs of neighbouring words; the others are dropped
    where they are listed, so only counts of wanted pairs are shuffled. Many
    wanted pairs are joined instead of sent out."""
    whole = lines.where("kind = 'body'").select(_whole_tokens().alias("w")).where(F.size("w") > 1)
    every = whole.select(F.explode(F.arrays_zip(
        F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    few = wanted.count() <= BROADCAST_WORDS
    if not few:
        every = every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    else:
        every = every.withColumn("n", F.lit(1))
    return every.join(F.broadcast(wanted) if few else wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n_ab"))


def broken_words(lines: DataFrame) -> DataFrame:
    """Words cut by a line end: their pieces and neighbours."""
    cut = lines.where("broken AND size(tokens) > 0").select(
        "line_id", "path", "page_no", "line_no", "next_page", "next_line",
        F.element_at("tokens", -1).alias("head"),
        F.try_element_at("tokens", F.lit(-2)).alias("before"),
    )
    nxt = lines.where("cont AND size(tokens) > 0").select(
        "path", F.col("page_no").alias("next_page"), F.col("line_no").alias("next_line"),
        F.element_at("tokens", 1).alias("tail"), F.try_element_at("tokens", F.lit(2)).alias("after"),
    )
    return cut.join(nxt, ["path", "next_page", "next_line"], "left")


def hyphen_faults(broken: DataFrame, words: DataFrame) -> DataFrame:
    """Broken words with ``joined`` (no hyphen of their own) decided."""
    firsts = (
        words.where(F.col("word").contains("-"))
        .select(F.explode(F.expr("transform(sequence(1, size(split(word, '-')) - 1), i -> array_join(slice(split(word, '-'), 1, i), '-'))")).alias("head"), "n")
        .groupBy("head").agg(F.sum("n").alias("n_first"))
    )
    plain = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    compound = words.select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    alone = words.select(F.col("word").alias("head"), F.col("n").alias("n_alone"))
    return (
        broken.withColumn("joined", F.concat("head", F.coalesce("tail", F.lit(""))))
        .withColumn("compound", F.concat("head", F.lit("-"), F.coalesce("tail", F.lit(""))))
        .join(plain, "joined", "left")
        .join(compound, "compound", "left")
        .join(firsts, "head", "left")
        .join(alone, "head", "left")
        .withColumn(
            "own_hyphen",
            F.when(
                F.col("tail").isNotNull(), F.coalesce("n_compound", F.lit(0)) > F.coalesce("n_joined", F.lit(0))
            ).otherwise(F.coalesce("n_first", F.lit(0)) > 0),
        )
        .drop("n_alone", "n_first", "n_compound")
    )


def skeleton(word: Column) -> Column:
    """What a word keeps under every confusion: look-alikes in one sign, letters
    that are read as two spelled as the two."""
    w = F.regexp_replace(word, "[uhb6]", "11")
    for letter, pair in (("d", "e1"), ("w", "vv"), ("m", "rr")):
        w = F.replace(w, F.lit(letter), F.lit(pair))
    w = F.translate(w, "ilcf05924n", "11etosgzar")
    return F.regexp_replace(w, "r1+", "r")


def align(true: str, read: str, costs: dict[tuple[str, str], float]) -> tuple[float, list[int]] | None:
    """Cheapest confusions (places in ``CONFUSIONS``) that read ``true`` as ``read``."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for i in range(len(true) + 1):
        for j in range(max(0, i - len(true) // 2 - 2), min(len(read), i + len(true) + 2) + 1):
            here = best.get((i, j))
            if here is None:
                continue
            steps = [(i + len(t), j + len(r), n) for n, (t, r) in enumerate(CONFUSIONS) if true.startswith(t, i) and read.startswith(r, j)]
            if i < len(true) and j < len(read) and true[i] == read[j]:
                steps.append((i + 1, j + 1, None))
            for x, y, n in steps:
                cost = here[0] + (costs[CONFUSIONS[n]] if n is not None else 0.0)
                if (x, y) not in best or cost < best[x, y][0]:
                    best[x, y] = (cost, here[1] + ((n,) if n is not None else ()))
    found = best.get((len(true), len(read)))
    return (found[0], list(found[1])) if found else None


def candidates(words: DataFrame, read: DataFrame) -> DataFrame:
    """word, n_read, cand, n_cand, uses: the words that each word as read may
    stand for, ``FREQUENT`` times as frequent, and the confusions between them."""
    flat = {c: 1.0 for c in CONFUSIONS}

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            uses = [align(c, w, flat) for c, w in zip(pdf["cand"], pdf["word"])]
            pdf["uses"] = [u[1] if u else None for u in uses]
            yield pdf[pdf["uses"].notna()]

    doubted = read.where((F.length("word") >= 2) & ~F.col("word").rlike(r"^\d+$")).select("word", F.col("n").alias("n_read"), skeleton(F.col("word")).alias("s"))
    known = words.where(F.col("n") >= FREQUENT).select(F.col("word").alias("cand"), F.col("n").alias("n_cand"), skeleton(F.col("word")).alias("s"))
    return (
        doubted.join(known, "s")
        .where((F.col("word") != F.col("cand")) & (F.col("n_cand") >= FREQUENT * F.greatest("n_read", F.lit(1))))
        .select("word", "n_read", "cand", "n_cand")
        .mapInPandas(aligned, "word string, n_read long, cand string, n_cand long, uses array<int>")
    )


def sign_counts(words: DataFrame) -> dict[str, float]:
    """Occurrences over the corpus of every sign that may be misread."""
    signs = sorted({t for t, _ in CONFUSIONS})
    seen = words.agg(
        *[
            F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(t), F.lit("")))) / len(t)).alias(f"s{i}")
            for i, t in enumerate(signs)
        ]
    ).first()
    return {t: float(seen[f"s{i}"] or 0) for i, t in enumerate(signs)}


def confusion_costs(decoded: DataFrame, pairs: DataFrame, occurs: dict[str, float]) -> list[float]:
    """Log probability of each confusion from the best paths, in the order of
    ``CONFUSIONS``; one row per confusion leaves Spark."""
    fixes = decoded.groupBy("word", "fixed").agg(F.count(F.lit(1)).alias("n_fixed"))
    used = (
        fixes.join(pairs.select("word", F.col("cand").alias("fixed"), "uses"), ["word", "fixed"])
        .select(F.explode("uses").alias("use"), "n_fixed").groupBy("use").agg(F.sum("n_fixed").alias("n"))
    )
    n_used = {r["use"]: float(r["n"]) for r in used.collect()}
    return [
        math.log((n_used.get(i, 0.0) + CONFUSED * CONFUSED_WEIGHT) / (max(occurs[t], n_used.get(i, 0.0)) + CONFUSED_WEIGHT))
        for i, (t, _) in enumerate(CONFUSIONS)
    ]


def _lattices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word pairs whose counts a line's lattice needs."""
    for pdf in batches:
        rows = []
        for key, tokens, doubts in zip(pdf["line_id"], pdf["tokens"], pdf["doubts"]):
            options = {d["pos"]: [c["cand"] for c in d["cands"]] for d in doubts}
            for i in range(len(tokens) - 1):
                if i in options or i + 1 in options:
                    rows += [
                        (key, a, b)
                        for a in [tokens[i], *options.get(i, [])] for b in [tokens[i + 1], *options.get(i + 1, [])]
                    ]
        yield pd.DataFrame(rows, columns=["line_id", "a", "b"]).drop_duplicates()


def viterbi(tokens, doubts, pairs: dict, total: float, costs: list[float]) -> list[str]:
    """Most likely words of a line, given the log probability of each confusion."""
    options = {d["pos"]: d for d in doubts}

    def states(i):
        d = options.get(i)
        if d is None:
            return [(tokens[i], 0.0, None)]
        own = [(tokens[i], LOG_KEEP, max(d["n_read"] - 1, 0) + 0.05)]
        return own + [(c["cand"], sum(costs[u] for u in c["uses"]), c["n_cand"]) for c in d["cands"]]

    def emit(prev, word, n):
        base = (n if n is not None else 1.0) / total
        if prev is None:
            return math.log(base)
        n_ab, n_a = pairs.get((prev, word), (0, 0))
        return math.log(BIGRAM_SHARE * (n_ab / n_a if n_a else 0) + (1 - BIGRAM_SHARE) * base)

    best = {w: (emit(None, w, n) + p, [w]) for w, p, n in states(0)}
    for i in range(1, len(tokens)):
        nxt = {}
        for w, p, n in states(i):
            score, path = max(
                ((s + emit(prev, w, n) + p, way) for prev, (s, way) in best.items()), key=lambda x: x[0]
            )
            nxt[w] = (score, path + [w])
        best = nxt
    return max(best.values(), key=lambda x: x[0])[1]


def _decode(lattices: DataFrame, costs: list[float]) -> DataFrame:
    """line_id, pos, word, fixed of the words that the best paths change."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, tokens, doubts, pairs, total in zip(
                pdf["line_id"], pdf["tokens"], pdf["doubts"], pdf["pairs"], pdf["total"]
            ):
                # the pairs of a doubtful word as read are no evidence for it: the
                # same misreading in the same phrase would vouch for itself
                read = {d["pos"] for d in doubts}
                own = {
                    (tokens[i], tokens[i + 1]) for i in range(len(tokens) - 1) if i in read or i + 1 in read
                }
                counts = {
                    (x["a"], x["b"]): (x["n_ab"], max(x["n_a"], 1))
                    for x in (pairs if pairs is not None else []) if (x["a"], x["b"]) not in own
                }
                way = viterbi(list(tokens), list(doubts), counts, float(total), costs)
                rows += [(key, i, a, b) for i, (a, b) in enumerate(zip(tokens, way)) if a != b]
            yield pd.DataFrame(rows, columns=["line_id", "pos", "word", "fixed"])

    return cut_lineage(lattices.mapInPandas(decode, "line_id long, pos int, word string, fixed string"))


def misread_words(lines: DataFrame, broken: DataFrame, words: DataFrame) -> DataFrame:
    """path, page_no, line_no, word, fixed of the words read wrongly."""
    texts = lines.where("kind = 'body'").select("line_id", _whole_tokens().alias("tokens"), F.lit(None).cast("int").alias("only"))
    # the join of a broken word is a line of its own, of negative number
    joins = broken.where("tail IS NOT NULL AND NOT own_hyphen").select(
        (-F.col("line_id") - 1).alias("line_id"),
        F.filter(F.array("before", "joined", "after"), lambda w: w.isNotNull()).alias("tokens"),
        F.when(F.col("before").isNull(), 0).otherwise(1).alias("only"),
    )
    every = texts.unionByName(joins).where(F.size("tokens") > 0)
    read = words.select("word", "n").unionByName(
        broken.where("tail IS NOT NULL AND n_joined IS NULL AND NOT own_hyphen").select(F.col("joined").alias("word"), F.lit(0).cast("long").alias("n")).distinct()
    )
    pairs_read = cut_lineage(candidates(words, read))
    cand = pairs_read.groupBy("word").agg(
        F.first("n_read").alias("n_read"), F.array_sort(F.collect_list(F.struct("cand", "uses", "n_cand"))).alias("cands")
    )
    # digits inside a word are a misreading even where no known word explains it
    odd = words.where(F.col("word").rlike(r"[a-z][0-9]+[a-z]|^[a-z]{2,}[0-9]$|^[0-9][a-z]{3,}$") & ~F.col("word").rlike(r"^\d+(st|nd|rd|th|ers?|e)$"))
    asked = written(cand.join(odd.select("word", F.lit(True).alias("odd")), "word", "full"))
    few = asked.count() <= BROADCAST_WORDS
    spots = every.select("line_id", "only", F.posexplode("tokens").alias("pos", "word"), *["tokens"] * few)
    spots = cut_lineage(
        spots.where(F.col("only").isNull() | (F.col("only") == F.col("pos"))).join(F.broadcast(asked) if few else asked, "word")
    )
    doubts = (
        spots.where("cands IS NOT NULL").groupBy("line_id")
        .agg(F.collect_list(F.struct("pos", "n_read", "cands")).alias("doubts"), *[F.first("tokens").alias("tokens")] * few)
    )
    doubtful = cut_lineage(doubts if few else every.select("line_id", "tokens").join(doubts, "line_id"))
    needed = doubtful.mapInPandas(_lattices, "line_id long, a string, b string")
    # the pairs of a line's lattice, spread by both words: no word is hot
    counted = pair_counts(lines, cut_lineage(needed.select("a", "b").distinct()))
    firsts = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    known = (
        needed.join(_with_first(counted, firsts), ["a", "b"])
        .groupBy("line_id")
        .agg(F.collect_list(F.struct("a", "b", "n_ab", "n_a")).alias("pairs"))
    )
    total = words.agg(F.sum("n").cast("double").alias("t"))
    lattices = cut_lineage(
        doubtful.join(known, "line_id", "left")
        .withColumn("total", F.coalesce(total.scalar(), F.lit(1.0)))
        .select("line_id", "tokens", "doubts", "pairs", "total")
    )
    occurs = sign_counts(words)
    decoded = _decode(lattices, [math.log(CONFUSED)] * len(CONFUSIONS))
    for _ in range(ROUNDS - 1):
        decoded = _decode(lattices, confusion_costs(decoded, pairs_read, occurs))
    own = lines.select("line_id", "path", "page_no", "line_no")
    same = F.expr("size(filter(sequence(1, least(length(word), length(fixed))), i -> substring(word, 1, i) = substring(fixed, 1, i)))")
    cut = broken.select("line_id", "path", "page_no", "line_no", "next_page", "next_line", F.length("head").alias("head_size"))
    joined = (
        decoded.where("line_id < 0").withColumn("line_id", -F.col("line_id") - 1).join(cut, "line_id")
        .withColumn("later", same >= F.col("head_size"))
        .select(
            "path",
            F.when(F.col("later"), F.col("next_page")).otherwise(F.col("page_no")).alias("page_no"),
            F.when(F.col("later"), F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"),
            "word", "fixed",
        )
    )
    mixed = spots.where("odd AND line_id >= 0").select("line_id", "word", F.translate("word", "015896", "olsbgb").alias("fixed")).distinct()
    plain = decoded.where("line_id >= 0").select("line_id", "word", "fixed")
    both = plain.unionByName(mixed.join(plain.select("line_id", "word"), ["line_id", "word"], "left_anti"))
    return both.join(own, "line_id").select("path", "page_no", "line_no", "word", "fixed").unionByName(joined)


def _with_first(counted: DataFrame, firsts: DataFrame) -> DataFrame:
    """Adds the count of the pair's first word. A frequent word begins many
    pairs, so they are folded into one row per word and salt before the join."""
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(32)))
    folded = salted.groupBy("a", "salt").agg(F.collect_list(F.struct("b", "n_ab")).alias("bs"))
    return folded.join(firsts, "a").select("a", "n_a", F.inline("bs"))


def _analysis(pdf_facts: DataFrame):
    lines = written(book_lines(pdf_facts).withColumn("line_id", F.monotonically_increasing_id()))
    words = written(word_counts(lines))
    broken = written(hyphen_faults(broken_words(lines), words))
    return lines, broken, misread_words(lines, broken, words)


def line_faults(pdf_facts: DataFrame) -> DataFrame:
    """path, page_no, line_no, fault of every faulty line."""
    lines, broken, misread = _analysis(pdf_facts)
    own = ["path", "page_no", "line_no"]
    kinds = lines.where("kind IN ('furniture', 'garbled')").select(*own, F.col("kind").alias("fault"))
    hyphens = broken.where("NOT own_hyphen").select(*own, F.lit("hyphen").alias("fault"))
    wrong = misread.select(*own, F.lit("misread").alias("fault"))
    return kinds.unionByName(hyphens).unionByName(wrong).distinct()


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, lines in zip(pdf["path"], pdf["lines"]):
            lines = sorted(lines, key=lambda x: (x["page_no"], x["line_no"]))
            width = max([len(x["text"]) for x in lines if x["kind"] == "body"], default=0)
            paragraphs, open_text, glue, last_page = [], "", " ", None

            def close():
                nonlocal open_text
                if open_text.strip():
                    paragraphs.append(open_text.strip())
                open_text = ""

            for x in lines:
                if x["kind"] in ("furniture", "garbled", "blank"):
                    continue
                text = x["text"]
                for f in x["fixes"] if x["fixes"] is not None else ():
                    text = re.sub(
                        rf"(?<!\w){re.escape(f['word'])}(?!\w)",
                        lambda m, to=f["fixed"]: to.capitalize() if m.group()[:1].isupper() else to,
                        text, flags=re.I,
                    )
                if x["kind"] == "heading":
                    close()
                    paragraphs.append(text)
                    continue
                if last_page is not None and x["page_no"] - last_page > 1:
                    close()
                last_page = x["page_no"]
                open_text = open_text + glue + text if open_text else text
                glue = " "
                if x["broken"]:
                    glue = ""
                    if not x["own_hyphen"]:
                        open_text = open_text[:-1]
                    elif open_text[-1] != "-":
                        open_text = open_text[:-1] + "-"
                elif len(text) < 0.85 * width and re.search(r"[.?!][\"”’)]?$", text):
                    close()
            close()
            rows += [(path, n, t) for n, t in enumerate(paragraphs, 1)]
        yield pd.DataFrame(rows, columns=["path", "para_no", "text"])


def repaired_paragraphs(pdf_facts: DataFrame) -> DataFrame:
    """path, para_no, text: each book's text as continuous paragraphs."""
    lines, broken, misread = _analysis(pdf_facts)
    own = ["path", "page_no", "line_no"]
    fixes = misread.groupBy(*own).agg(F.collect_set(F.struct("word", "fixed")).alias("fixes"))
    return (
        lines.join(broken.select(*own, "own_hyphen"), own, "left")
        .join(fixes, own, "left")
        .groupBy("path")
        .agg(F.collect_list(F.struct("page_no", "line_no", "kind", "text", "broken", "own_hyphen", "fixes")).alias("lines"))
        .mapInPandas(_repair, "path string, para_no int, text string")
    )

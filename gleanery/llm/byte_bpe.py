"""Corpus encoding with a public byte-level BPE vocabulary.

The vocabulary's rank map is a constant of the plan: an array of hash buckets,
each a small map from the hex form of a byte string to its rank, so a lookup
costs the same at every vocabulary size. A word is folded with higher-order
functions: its byte array starts as single bytes, and each step joins the
adjacent pair of lowest rank, leftmost first, until no pair has a rank.

Constants are scalar subqueries over one row, each named once in an expression:
a task gets one flat copy. As literals of the expression they were written out
in every description of the plan that Spark keeps on the driver, and each task
built them anew, as objects, once for every place that named them.

Words repeat, so the fold runs on the distinct words of the corpus; the
``HOT_WORDS`` most frequent ones (a fixed bound) come back as a second constant,
and each document maps its words through it in place. A word outside it is
folded where it stands, so every text is encoded whole and no document is ever
shuffled. Documents with a word of more than ``LONG_WORD`` bytes go through the
same ranked merges with a heap, where the quadratic fold would be too slow.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; decoding unknown ids gives null.
"""

from __future__ import annotations

import base64
import binascii
import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_WORDS = 65_536
LONG_WORD = 256
RANK_BUCKETS = 65_536
#: Tasks that fold the hot words.
FOLD_TASKS = 24
#: Word pattern of the public vocabulary (fixed value), with Unicode white space.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NO_RANK = 2_147_483_647


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 byte string and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _bucketed(entries: list[tuple[str, object]], n: int) -> str:
    buckets: list[dict] = [{} for _ in range(n)]
    for key, value in entries:
        buckets[binascii.crc32(key.encode("utf-8")) % n][key] = value
    return json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))


def _lookup(table: Column, key: Column, n: int) -> Column:
    """Value of ``key`` in a bucketed constant, null when absent."""
    bucket = F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int"))
    return F.try_element_at(bucket, key)


def _constant(spark: SparkSession, text: str, kind: str) -> Column:
    """A JSON text as a value of ``kind``."""
    return spark.createDataFrame([(text,)], "t string").select(F.from_json("t", kind)).scalar()


def _using(df: DataFrame, constants: dict[str, Column], name: str, use: Callable[[Column], Column]) -> DataFrame:
    """``df`` with a column: ``use`` of the struct of the constants. As that is named
    once, both projections become one, and no row holds the constants."""
    held = df.select("*", F.struct(*[v.alias(k) for k, v in constants.items()]).alias("_held"))
    return held.select(*df.columns, F.element_at(F.transform(F.array("_held"), use), 1).alias(name))


class Encoder:
    """Column expressions for one rank file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.ranks = read_ranks(path)
        self.rank_table = _constant(
            spark, _bucketed([(k.hex().upper(), r) for k, r in self.ranks.items()], RANK_BUCKETS), "array<map<string,int>>"
        )

    def fold(self, word: Column, ranks: Column) -> Column:
        """Ids of one word by ranked merges over its byte array; ``ranks`` is the rank table."""

        def rank(piece: Column) -> Column:
            return _lookup(ranks, piece, RANK_BUCKETS)

        code = F.hex(F.encode(word, "UTF-8"))
        size = F.length(code)
        pieces = F.transform(
            F.sequence(F.lit(1), size, F.lit(2)), lambda i: F.substring(code, i, F.lit(2))
        )

        def merge(acc: Column, _: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(1), F.size(acc) - 1),
                lambda j: F.struct(
                    F.coalesce(
                        rank(F.concat(F.element_at(acc, j), F.element_at(acc, j + 1))), F.lit(_NO_RANK)
                    ).alias("r"),
                    j.alias("j"),
                ),
            )
            spliced = F.transform(
                F.array(F.array_min(pairs)),
                lambda b: F.when(b["r"] == _NO_RANK, acc).otherwise(
                    F.concat(
                        F.slice(acc, F.lit(1), b["j"] - 1),
                        F.array(F.concat(F.element_at(acc, b["j"]), F.element_at(acc, b["j"] + 1))),
                        F.slice(acc, b["j"] + 2, F.size(acc)),
                    )
                ),
            )
            return F.when(F.size(acc) < 2, acc).otherwise(F.element_at(spliced, 1))

        merged = F.when(rank(code).isNotNull(), F.array(code)).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(size / 2) - 1, F.lit(1))), pieces, merge)
        )
        return F.transform(merged, lambda p: rank(p))

    def hot_table(self, words: DataFrame) -> Column:
        """Constant of the most frequent words and their ids."""
        counts = (
            words.select(F.explode("words").alias("word"))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.octet_length("word") <= LONG_WORD)
            .orderBy(F.desc("n"), "word")
            .limit(HOT_WORDS)
        )
        # without the exchange the words would be folded where the limit ends, on the driver
        spread = counts.select("word").repartition(FOLD_TASKS)
        rows = _using(spread, {"ranks": self.rank_table}, "ids", lambda c: self.fold(F.col("word"), c["ranks"])).collect()
        return _constant(
            self.spark, _bucketed([(r["word"], r["ids"]) for r in rows], RANK_BUCKETS), "array<map<string,array<int>>>"
        )


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of one long word with a heap of adjacent pairs."""
    if piece in ranks:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i:i + 1] for i in range(len(piece))]
    left = list(range(-1, len(parts) - 1))
    right = list(range(1, len(parts) + 1))
    heap = []

    def push(i: int) -> None:
        j = right[i]
        if j < len(parts):
            r = ranks.get(parts[i] + parts[j])
            if r is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        right[i] = right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [ranks[p] for p in parts if p is not None]


def encode_texts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids of every text."""
    encoder = Encoder(documents.sparkSession, path)
    words = documents.select(
        F.col(key), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0)).alias("words")
    )
    hot = encoder.hot_table(words)
    long = F.exists("words", lambda w: F.octet_length(w) > LONG_WORD)
    plain = _using(
        words.where(~long), {"hot": hot, "ranks": encoder.rank_table}, "ids",
        lambda c: F.flatten(
            F.transform("words", lambda w: F.coalesce(_lookup(c["hot"], w, RANK_BUCKETS), encoder.fold(w, c["ranks"])))
        ),
    ).select(key, "ids")

    def by_heap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = None
        for pdf in batches:
            if len(pdf) and ranks is None:
                ranks = encoder_ranks
            yield pd.DataFrame(
                {
                    key: pdf[key],
                    "ids": [[i for w in ws for i in merge_bytes(w.encode("utf-8"), ranks)] for ws in pdf["words"]],
                }
            )

    encoder_ranks = encoder.ranks
    rest = words.where(long).mapInPandas(by_heap, f"{key} {dict(words.dtypes)[key]}, ids array<int>")
    return plain.unionByName(rest)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, text: the binary pieces of the ids, concatenated and read as UTF-8."""
    ranks = read_ranks(path)
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, r in ranks.items():
        by_id[r] = piece.hex().upper()
    table = _constant(encoded.sparkSession, json.dumps(by_id, separators=(",", ":")), "array<string>")
    pieces = _using(encoded.select(key, "ids"), {"table": table}, "_pieces", lambda c: F.transform("ids", lambda i: F.get(c["table"], i)))
    complete = ~F.exists("_pieces", lambda p: p.isNull())
    return pieces.select(
        key, F.when(complete, F.decode(F.unhex(F.array_join("_pieces", "")), "UTF-8")).alias("text")
    )

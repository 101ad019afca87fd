"""Near-duplicate records by multi-index hashing.

A record's fingerprint is its word set, one position per word. For two sets
of sizes n <= n' whose shared words are at least 0.8 of all words, the Hamming
distance (words in one set only) is at most (n + n') / 9, and at most n / 4.
The word universe is cut into m > d / 2 segments by word hash, so by the
pigeonhole principle one segment differs in at most one word. Each
segment is a hash table; a record enters it under its own segment value and
under the small ball around it (the segment without one of its words). Two
records meet in a table when their segment values are equal or one is the
other less one word, which covers every pair: no candidate is lost. The table
match is checked against a 40-bit parity folding of the whole fingerprint,
whose Hamming distance never exceeds the true one, then the complete distance
is verified on the sets themselves.

m depends on the size class of the smaller partner, so a record enters the tables
of each m that a partner of 0.8 to 1 times its size may use; sets of fewer than four words
have no partner but their equals and enter none.

A segment value of fewer than two or three words names little or nothing and
would be shared by records without end. Its key is completed by one of the
record's rarest words: similar sets share one of their n // 5 + 1 rarest words
under any order, so the key is written once for each of them and still no
candidate is lost. The order is by the counts of a fixed number of word
buckets, then by hash; only these counts reach the workers.

Records with equal word sets are one class first; only classes are compared,
so a group of copies costs one record. Short strings use the same scheme over
characters: an id and its single-character deletions are the ball, and the
edit is verified in full.

Results: all pairs between records of different texts, of one class or of similar
classes. Exact copies (the same text) are paired too, up to ``EXPANDED_CLASS``
of them; more are linked to their first member, and only that member stands for
its text in other pairs, so copies stay linear in the input and groups stay
whole. Null and wordless texts match nothing; redelivered records count
once; a key redelivered with other text keeps each text.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut_lineage

#: Copies of one text whose pairs are written out in full.
EXPANDED_CLASS = 50

#: Buckets of the word counts that order words by rarity.
COUNT_BUCKETS = 1 << 18
#: Table rows a task of the candidate join takes.
ROWS_PER_TASK = 500_000

#: Bits of a table key that are kept; chance meetings are verified like others.
_KEY_MASK = np.uint64((1 << 48) - 1)
#: A table row is three numbers; sig holds 40 parity bits, the set's size and
#: whether the row is of the ball.
_KEYS = "key long, id long, sig long"
_PARITY_SHIFT, _SIZE_BITS = 24, 23


def budget(n: int) -> int:
    """Largest distance of a pair whose smaller set has n words."""
    return n // 4


#: Sizes at which a class begins: the powers of the square root of two.
_CLASSES = sorted({math.ceil(2 ** (i / 2)) for i in range(100)})


def segments(n: int) -> int:
    """Segments for pairs whose smaller set has n words. More are never wrong, so
    the sizes of a class share one number, and a record enters few families of
    tables."""
    largest = _CLASSES[bisect_right(_CLASSES, n)] - 1
    return budget(largest) // 2 + 1


def plain_words(m: int) -> int:
    """Segment values of fewer words are completed by a rare word. Long sets have
    many rare words and short values are uncommon among their many segments."""
    return 3 if m <= 2 else 2


def segment_counts(n: int) -> list[int]:
    """Table families a set of n words enters: one per class of possible smaller
    partners that may differ at all."""
    return sorted({segments(k) for k in range(-(-4 * n // 5), n + 1) if budget(k) > 0})


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix constants)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _rarest(n: np.ndarray, offsets: np.ndarray, mixed: np.ndarray, counts: np.ndarray | None):
    """Offsets and hashes of each record's n // 5 + 1 rarest words."""
    owner = np.repeat(np.arange(len(n)), n)
    seen = counts[(mixed >> np.uint64(20)) % np.uint64(len(counts))] if counts is not None else np.zeros(len(mixed), np.int64)
    order = np.lexsort((mixed, seen, owner))
    place = np.arange(len(mixed)) - np.repeat(offsets[:-1], n)
    taken = order[place < np.repeat(n // 5 + 1, n)]
    size = np.where(n > 0, n // 5 + 1, 0)
    return np.concatenate([[0], np.cumsum(size)]), mixed[taken]


def table_rows(ids: np.ndarray, offsets: np.ndarray, words: np.ndarray, with_ball: bool, counts: np.ndarray | None = None):
    """Hash-table rows of a batch of sets: key, id, sig."""
    n = np.diff(offsets)
    mixed = _mix(words.astype(np.int64).astype(np.uint64))
    owner = np.repeat(np.arange(len(n)), n)
    bits = np.left_shift(np.int64(1), ((mixed >> np.uint64(33)) % np.uint64(40)).astype(np.int64))
    parity = np.zeros(len(n), np.int64)
    filled = n > 0
    if filled.any():
        parity[filled] = np.bitwise_xor.reduceat(bits, offsets[:-1][filled])
    sig = (parity << _PARITY_SHIFT) | (n.astype(np.int64) << 1)
    rare_at, rare = _rarest(n, offsets, mixed, counts)

    def rows(key: np.ndarray, doc: np.ndarray, size: np.ndarray, ball: int, least: int):
        """Rows of plain keys as they are, others once for each rare word."""
        few = np.flatnonzero(size < least)
        many = np.flatnonzero(size >= least)
        times = np.diff(rare_at)[doc[few]]
        row = np.repeat(few, times)
        start = np.repeat(rare_at[doc[few]], times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        keys = np.concatenate([key[many], _mix(key[row] ^ rare[start + step])])
        docs = np.concatenate([doc[many], doc[row]])
        return (keys & _KEY_MASK).view(np.int64), ids[docs], sig[docs] | ball

    families = {int(k): segment_counts(int(k)) for k in np.unique(n[filled])}
    for m in sorted({m for ms in families.values() for m in ms}):
        sizes = [k for k, ms in families.items() if m in ms]
        chosen = np.isin(n, sizes)
        rank = np.cumsum(chosen) - 1
        take = chosen[owner]
        doc, val = owner[take], mixed[take]
        seg = (val >> np.uint64(7)) % np.uint64(m)
        cell = rank[doc] * m + seg.astype(np.int64)
        n_cells = int(chosen.sum()) * m
        total = np.zeros(n_cells, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, cell, val)
        size = np.bincount(cell, minlength=n_cells)
        salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64(m * 1000))
        docs = np.flatnonzero(chosen)
        yield rows(_mix(total ^ np.tile(salt, len(docs))), np.repeat(docs, m), size, 0, plain_words(m))
        if with_ball:
            with np.errstate(over="ignore"):
                less = total[cell] - val
            yield rows(_mix(less ^ salt[seg.astype(np.int64)]), doc, size[cell] - 1, 1, plain_words(m))


def word_bucket_counts(classes: DataFrame) -> np.ndarray:
    """Sets per bucket of word hashes: a fixed number of counts."""
    counts = np.zeros(COUNT_BUCKETS, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False)
            mixed = _mix(words.astype(np.int64).astype(np.uint64))
            total += np.bincount(((mixed >> np.uint64(20)) % np.uint64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    found = classes.select("words").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _tables(classes: DataFrame, with_ball: bool, counts: np.ndarray) -> DataFrame:
    names = ["key", "id", "sig"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("words")
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            offsets = col.offsets.to_numpy().astype(np.int64)
            words = col.values.to_numpy(zero_copy_only=False)
            words = words[offsets[0]: offsets[-1]]
            for part in table_rows(ids, offsets - offsets[0], words, with_ball, counts):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=names)

    return classes.select("id", "words").mapInArrow(rows, _KEYS)


def word_sets(df: DataFrame, table_name: str, key: str, text: str) -> DataFrame:
    """rec_table, key, set_a, set_b (128-bit name of the word set), exact (name
    of the text itself), words."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9']+"), F.lit(0))))
    return (
        df.select(
            F.lit(table_name).alias("rec_table"), F.col(key).cast("string").alias("key"),
            F.xxhash64(text).alias("exact"), found.alias("w"),
        )
        .where(F.col("key").isNotNull() & (F.size("w") > 0))
        .select(
            "rec_table", "key",
            F.xxhash64("rec_table", "w").alias("set_a"),
            F.xxhash64("w", F.lit(1)).alias("set_b"),
            "exact",
            F.transform("w", lambda x: F.hash(x)).alias("words"),
        )
    )


def set_classes(sets: DataFrame) -> DataFrame:
    """One row per distinct word set: rec_table, id, words, n_rows."""
    members = sets.groupBy("rec_table", "set_a", "set_b").agg(
        F.min(F.struct("key", "words")).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    flat = members.select(
        "rec_table", "set_a", "set_b", F.array_sort(F.array_distinct("first.words")).alias("words"), "n_rows",
    )
    return cut_lineage(flat).withColumn("id", F.monotonically_increasing_id())


def similar_classes(classes: DataFrame) -> DataFrame:
    """id_a, id_b of the classes whose word sets are similar (one table's)."""
    counts = word_bucket_counts(classes)
    # partitions follow the input: a set of n words has about 2 n rows
    n_words = classes.agg(F.sum(F.size("words"))).first()[0] or 0
    n_parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * n_words // ROWS_PER_TASK)
    full = _tables(classes, False, counts).repartition(n_parts, "key").alias("a")
    ball = _tables(classes, True, counts).repartition(n_parts, "key").alias("b")
    def size(side: str):
        return F.shiftright(f"{side}.sig", 1).bitwiseAND((1 << _SIZE_BITS) - 1)

    apart = F.bit_count(F.shiftrightunsigned(F.col("a.sig").bitwiseXOR(F.col("b.sig")), _PARITY_SHIFT))
    met = (
        full.join(
            ball,
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.id") != F.col("b.id"))
            & ((F.col("b.sig").bitwiseAND(1) == 1) | (F.col("a.id") < F.col("b.id")))
            & (apart * 9 <= size("a") + size("b"))
            & (F.least(size("a"), size("b")) * 5 >= F.greatest(size("a"), size("b")) * 4),
        )
        .select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))
        .distinct()
    )
    left = classes.select(F.col("id").alias("id_a"), F.col("words").alias("w_a"))
    right = classes.select(F.col("id").alias("id_b"), F.col("words").alias("w_b"))
    shared = F.size(F.array_intersect("w_a", "w_b"))
    return (
        met.join(left, "id_a")
        .join(right, "id_b")
        .where(shared * 5 >= (F.size("w_a") + F.size("w_b") - shared) * 4)
        .select("id_a", "id_b")
    )


def class_members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """id, key, n_rows, rep, n_copies of every record: rep is the first record of
    its text, n_copies their number."""
    own = sets.select("rec_table", "set_a", "set_b", "exact", "key").distinct()
    texts = own.groupBy("rec_table", "set_a", "set_b", "exact").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("n_copies")
    )
    return (
        own.join(texts, ["rec_table", "set_a", "set_b", "exact"])
        .join(classes.drop("words"), ["rec_table", "set_a", "set_b"])
        .select("id", "key", "n_rows", "rep", "n_copies")
    )


def similar_records(df: DataFrame, table_name: str, key: str, text: str) -> DataFrame:
    """rec_table, key_a, key_b of one table's near-duplicate records."""
    sets = word_sets(df, table_name, key, text)
    classes = set_classes(sets)
    pairs = similar_classes(classes)
    members = class_members(sets, classes)
    shown = members.where((F.col("n_copies") <= EXPANDED_CLASS) | (F.col("key") == F.col("rep"))).select("id", "key", "n_rows")
    several = shown.where("n_rows > 1")
    inside = (
        several.alias("x")
        .join(several.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.key") < F.col("y.key")))
        .select(F.col("x.key").alias("p"), F.col("y.key").alias("q"))
    )
    copies = members.where((F.col("n_copies") > EXPANDED_CLASS) & (F.col("key") != F.col("rep"))).select(
        F.col("rep").alias("p"), F.col("key").alias("q")
    )
    across = (
        pairs.join(shown.select(F.col("id").alias("id_a"), F.col("key").alias("p")), "id_a")
        .join(shown.select(F.col("id").alias("id_b"), F.col("key").alias("q")), "id_b")
        .where(F.col("p") != F.col("q"))
        .select("p", "q")
    )
    return (
        inside.unionByName(copies)
        .unionByName(across)
        .select(F.lit(table_name).alias("rec_table"), F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b"))
        .distinct()
    )


def one_edit_apart(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """Pairs of distinct ids one insertion, deletion, replacement or swap of
    neighbouring characters apart (case matters)."""
    ids = df.select(F.col(key).cast("string").alias("k")).where(F.col("k").isNotNull() & (F.col("k") != "")).distinct()
    cut = F.expr("transform(sequence(1, length(k)), i -> concat(substring(k, 1, i - 1), substring(k, i + 1)))")
    ball = ids.select("k", F.explode(F.array_distinct(F.concat(F.array("k"), cut))).alias("v")).select(
        "k", F.xxhash64("v").alias("key")
    )
    swapped = F.expr(
        "length(p) = length(q) AND length(p) > 1 AND exists(sequence(1, greatest(length(p) - 1, 1)), i -> "
        "concat(substring(p, 1, i - 1), substring(p, i + 1, 1), substring(p, i, 1), substring(p, i + 2)) = q)"
    )
    return (
        ball.select(F.col("k").alias("p"), "key")
        .join(ball.select(F.col("k").alias("q"), "key"), "key")
        .where("p < q")
        .select("p", "q")
        .distinct()
        .where((F.levenshtein("p", "q", 1) == 1) | swapped)
        .select(F.lit(table_name).alias("rec_table"), F.col("p").alias("key_a"), F.col("q").alias("key_b"))
    )


def connected_groups(edges: DataFrame) -> DataFrame:
    """rec_table, key, group_key, n_links: components of the pair graph.

    Minimum labels spread along edges with pointer jumping, so the number of
    rounds grows with the logarithm of the longest chain; each round is cut to
    the shared checkpoint folder."""
    both = cut_lineage(
        edges.select("rec_table", F.col("key_a").alias("k"), F.col("key_b").alias("o")).unionByName(
            edges.select("rec_table", F.col("key_b").alias("k"), F.col("key_a").alias("o"))
        )
    )
    links = both.groupBy("rec_table", "k").agg(F.count(F.lit(1)).alias("n_links"), F.min("o").alias("m"))
    labels = cut_lineage(links.select("rec_table", "k", F.least("k", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select("rec_table", F.col("k").alias("o"), F.col("label").alias("l")), ["rec_table", "o"])
            .groupBy("rec_table", "k")
            .agg(F.min("l").alias("l"))
        )
        hop = labels.select("rec_table", F.col("k").alias("label"), F.col("label").alias("up"))
        step = (
            labels.join(near, ["rec_table", "k"])
            .join(hop, ["rec_table", "label"], "left")
            .select(
                "rec_table", "k", F.least("label", "l", F.coalesce("up", "label")).alias("new"),
                (F.least("label", "l", F.coalesce("up", "label")) != F.col("label")).alias("moved"),
            )
        )
        step = cut_lineage(step)
        labels = step.select("rec_table", "k", F.col("new").alias("label"))
        if step.where("moved").isEmpty():
            break
    return labels.join(links.select("rec_table", "k", "n_links"), ["rec_table", "k"]).select(
        "rec_table", F.col("k").alias("key"), F.col("label").alias("group_key"), "n_links"
    )

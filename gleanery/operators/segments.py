"""Segmentation folds over ordered cues and units.

A unit sequence belongs to one document; the folds run inside one array value
(higher-order functions) or one document's group, never across documents."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import est_tokens, n_words, words


def rolling_dedup(cues: DataFrame, doc: str = "doc_id", start: str = "start_ms", text: str = "text") -> DataFrame:
    """Drop the longest suffix of the previous cue that begins this cue.

    The previous cue is taken as delivered, so the rule needs no state: a lag
    over non-empty cues and a search over suffix lengths."""
    w = Window.partitionBy(doc).orderBy(start, "cue_no")
    prev = F.coalesce(F.lag("w").over(w), F.array().cast("array<string>"))
    longest = F.expr(
        "coalesce(get(filter(CASE WHEN least(size(prev), size(w)) > 0 THEN sequence(least(size(prev), size(w)), 1, -1) "
        "ELSE array() END, k -> slice(prev, -k, k) = slice(w, 1, k)), 0), 0)"
    )
    return (
        cues.withColumn("w", words(F.col(text)))
        .where(F.size("w") > 0)
        .withColumn("prev", prev)
        .withColumn("n_dropped", longest)
        .withColumn("fresh", F.expr("CASE WHEN n_dropped >= size(w) THEN '' ELSE array_join(slice(w, n_dropped + 1, size(w)), ' ') END"))
        .drop("w", "prev")
    )


def merge_utterances(cues: DataFrame, max_span: int = 25_000, max_gap: int = 1_200) -> DataFrame:
    """doc_id, start_ms, end_ms, n_cues: cues merged until the span exceeds
    ``max_span`` or the pause ``max_gap``. One aggregate over the document's
    sorted cues; the span depends on the group's own start, so a session
    window cannot express it."""
    step = f"""
      CASE WHEN size(acc) = 0 OR x.end_ms - element_at(acc, -1).start_ms > {max_span}
             OR x.start_ms - element_at(acc, -1).end_ms > {max_gap}
        THEN concat(acc, array(named_struct('start_ms', x.start_ms, 'end_ms', x.end_ms, 'n_cues', 1)))
        ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct(
          'start_ms', element_at(acc, -1).start_ms, 'end_ms', greatest(element_at(acc, -1).end_ms, x.end_ms),
          'n_cues', element_at(acc, -1).n_cues + 1))) END"""
    empty = "cast(array() as array<struct<start_ms: bigint, end_ms: bigint, n_cues: int>>)"
    return (
        cues.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("cues"))
        .select("doc_id", F.expr(f"inline(aggregate(cues, {empty}, (acc, x) -> {step}))"))
    )


def chunk_units(units: DataFrame, budget: int = 550, overlap: float = 0.18) -> DataFrame:
    """Chunks of units with carried overlap: flush when the next unit would
    pass the budget, carry a tail of at most the overlap share, never a whole
    chunk, and never emit a chunk of carried units only.

    ``units`` has doc_id, pos, text; the result doc_id, chunk_no, first_pos,
    last_pos, n_tokens."""
    counted = (
        units.select("doc_id", "pos", est_tokens(F.col("text")).alias("t"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("u"))
        .select("doc_id", F.col("u.pos").alias("pos"), F.col("u.t").alias("t"))
    )
    limit = overlap * budget

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, pos, sizes in zip(pdf["doc_id"], pdf["pos"], pdf["t"]):
                sums = [0, *accumulate(sizes.tolist())]  # sums[j] - sums[i]: size of units i to j - 1
                first, number = 0, 0
                for i in range(1, len(pos)):
                    if sums[i + 1] - sums[first] > budget:
                        rows.append((doc, number, pos[first], pos[i - 1], sums[i] - sums[first]))
                        number += 1
                        # the longest tail within the overlap, but never the whole chunk
                        first = max(first + 1, bisect_left(sums, sums[i] - limit, first + 1, i + 1))
                if len(pos):
                    rows.append((doc, number, pos[first], pos[-1], sums[-1] - sums[first]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "first_pos", "last_pos", "n_tokens"])

    return counted.mapInPandas(fold, "doc_id long, chunk_no int, first_pos long, last_pos long, n_tokens long")


def greedy_windows(units: DataFrame, budget: int) -> DataFrame:
    """doc_id, pos, window_no: a new window when the running size would pass
    the budget (parents of chunks, extraction windows)."""
    sized = units.select("doc_id", "pos", est_tokens(F.col("text")).alias("t"))
    step = f"""CASE WHEN acc.size > 0 AND acc.size + x.t > {budget}
        THEN named_struct('size', x.t, 'no', acc.no + 1, 'out', concat(acc.out, array(named_struct('pos', x.pos, 'window_no', acc.no + 1))))
        ELSE named_struct('size', acc.size + x.t, 'no', acc.no, 'out', concat(acc.out, array(named_struct('pos', x.pos, 'window_no', acc.no)))) END"""
    zero = "named_struct('size', 0L, 'no', 0, 'out', cast(array() as array<struct<pos: bigint, window_no: int>>))"
    return (
        sized.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("u"))
        .select("doc_id", F.expr(f"inline(aggregate(u, {zero}, (acc, x) -> {step}, acc -> acc.out))"))
    )


def split_long(units: DataFrame, max_words: int = 580) -> DataFrame:
    """doc_id, pos, part, n_words: units longer than ``max_words`` in equal parts."""
    n = n_words(F.col("text"))
    parts = F.greatest(F.lit(1), F.ceil(n / max_words).cast("int"))
    return (
        units.withColumn("n", n).withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        .withColumn("step", F.ceil(F.col("n") / F.col("parts")))
        .select(
            "doc_id", "pos", "part",
            F.greatest(F.lit(0), F.least(F.col("step"), F.col("n") - (F.col("part") - 1) * F.col("step"))).cast("long").alias("n_words"),
        )
    )

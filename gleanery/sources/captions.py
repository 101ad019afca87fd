"""Caption files (SRT and WebVTT) as cue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIMING = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"


def millis(clock: Column) -> Column:
    """Milliseconds of [h:]mm:ss.mmm."""
    parts = F.split(F.regexp_replace(clock, ",", "."), ":")
    n = F.size(parts)
    seconds = F.element_at(parts, -1).cast("decimal(12,3)")
    minutes = F.element_at(parts, -2).cast("long")
    hours = F.when(n > 2, F.element_at(parts, 1).cast("long")).otherwise(F.lit(0))
    return (hours * 3_600_000 + minutes * 60_000).cast("long") + (seconds * 1000).cast("long")


def parse_captions(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, cue_no, start_ms, dur_ms, text: blank-line blocks whose first timing
    line counts; byte marks, carriage returns, tags and index lines dropped;
    cues without text dropped, durations not below 0."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "﻿|\r", ""), r"[ \t]+\n", "\n")
    blocks = files.select(key, F.posexplode(F.split(clean, r"\n\s*\n")).alias("cue_no", "block"))
    start, end = millis(F.regexp_extract("block", _TIMING, 1)), millis(F.regexp_extract("block", _TIMING, 2))
    body = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), "<[^>]*>", "")
    return (
        blocks.where(F.col("block").rlike(_TIMING))
        .select(
            key, "cue_no", start.alias("start_ms"), F.greatest(F.lit(0), end - start).alias("dur_ms"),
            F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"),
        )
        .where("text <> ''")
    )


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return parse_captions(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))

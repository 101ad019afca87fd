"""Domains of items and documents from their similarity to domain profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Profiles are a declared list; more are a mistake.
MOST_PROFILES = 1024
# fixed values: settings that are tried against labels
GRID = {"floor": (0.35, 0.40, 0.45, 0.50, 0.55, 0.60), "close": (0.01, 0.02, 0.04), "share": (0.1, 0.2, 0.3), "min_passages": (1, 2)}
SURE_SHARE = 0.5


def profile_scores(vectors: DataFrame, key: str, data: str, profiles: list[tuple[str, list[float]]]) -> DataFrame:
    """key, scores (array of domain and cosine, by domain): every vector against the
    declared profiles, in the batch it is read in."""
    if len(profiles) > MOST_PROFILES:
        raise ValueError(f"{len(profiles)} profiles; at most {MOST_PROFILES} can be declared")
    profiles = sorted(profiles)
    names = [n for n, _ in profiles]
    base = np.array([p for _, p in profiles], np.float64).reshape(len(profiles), -1)
    base /= np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-12)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[data].tolist(), np.float64).reshape(len(pdf), -1)
            cos = x @ base.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: pdf[key], "scores": [[{"domain": n, "score": c} for n, c in zip(names, row)] for row in cos.tolist()]})

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, data).where(F.col(data).isNotNull()).mapInPandas(score, f"{key} {kind}, scores array<struct<domain: string, score: double>>")


def candidates(scores: Column, floor: Column, close: Column, hint: Column | None = None, bonus: float = 0.0) -> Column:
    """Domains of an item: none unless the best reaches the floor, else all from the
    floor on that are close to the best, best first; a hinted domain gets a bonus."""
    if hint is not None:
        scores = F.transform(scores, lambda s: F.struct(s["domain"].alias("domain"), (s["score"] + F.when(s["domain"] == hint, bonus).otherwise(0.0)).alias("score")))
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    kept = F.filter(scores, lambda s: (s["score"] >= floor) & (s["score"] >= best - close))
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct((-s["score"]).alias("a"), s["domain"].alias("domain")))), lambda s: s["domain"])


def document_tags(items: DataFrame, by: list[str], share: Column, min_passages: Column, default: str) -> DataFrame:
    """by..., domains, origin of every document.

    ``items`` has by..., is_passage, tags, hint. A domain counts from its share of
    the tagged passages on (rounded to three digits first), if enough passages name
    it or half of them do; without one the most frequent domains of the other
    items, then the hint, then the default."""
    groups = items.groupBy(*by).agg(
        F.count_if(F.col("is_passage") & (F.size("tags") > 0)).alias("tagged"), F.first("hint", ignorenulls=True).alias("hint"),
        F.first(share).alias("share"), F.first(min_passages).alias("min_passages"),
    )
    counts = items.select(*by, "is_passage", F.explode("tags").alias("domain")).groupBy(*by, "domain").agg(
        F.count_if("is_passage").alias("n"), F.count_if(~F.col("is_passage")).alias("n_other")
    )
    per = Window.partitionBy(*by)
    rows = groups.join(counts, by, "left").withColumn("part", F.when(F.col("tagged") > 0, F.floor(F.col("n") * 1000 / F.col("tagged") + 0.5)))
    mine = (F.col("n") > 0) & (F.col("part") >= F.col("share") * 1000 - 1e-9) & (
        (F.col("n") >= F.least("min_passages", "tagged")) | (F.col("part") >= SURE_SHARE * 1000)
    )
    top = (F.col("n_other") > 0) & (F.col("n_other") == F.max("n_other").over(per))
    marked = rows.withColumn("mine", F.coalesce(mine, F.lit(False))).withColumn("top", F.coalesce(top, F.lit(False)))
    got = marked.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("mine"), F.struct((-F.col("part")).alias("a"), "domain")))).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("top"), F.col("domain")))).alias("other"), F.first("hint").alias("hint"),
    )
    return got.select(
        *by,
        F.when(F.size("own") > 0, F.col("own.domain")).when(F.size("other") > 0, F.col("other"))
        .when(F.col("hint").isNotNull(), F.array("hint")).otherwise(F.array(F.lit(default))).alias("domains"),
        F.when(F.size("own") > 0, "passages").when(F.size("other") > 0, "items").when(F.col("hint").isNotNull(), "hint").otherwise("default").alias("origin"),
    )


def settings() -> Column:
    """All settings of the grid as an array of structs."""
    return F.array(*[
        F.struct(F.lit(f).alias("floor"), F.lit(c).alias("close"), F.lit(s).alias("share"), F.lit(m).alias("min_passages"))
        for f in GRID["floor"] for c in GRID["close"] for s in GRID["share"] for m in GRID["min_passages"]
    ])


def label_counts(found: DataFrame, truth: DataFrame, by: list[str], key: str) -> DataFrame:
    """by..., tp, fp, fn of found against true domains (arrays) of the labelled keys."""
    both = found.join(truth.select(key, F.col("domains").alias("want")), key)
    tp = F.size(F.array_intersect("domains", "want"))
    return both.groupBy(*by).agg(
        F.sum(tp).alias("tp"), F.sum(F.size(F.array_distinct("domains")) - tp).alias("fp"), F.sum(F.size(F.array_distinct("want")) - tp).alias("fn")
    )

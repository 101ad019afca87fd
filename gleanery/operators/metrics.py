"""Retrieval metrics of ranked runs against graded judgments, and their comparison.

``runs`` has qid, did, rank (from 1), ``qrels`` qid, did, grade. Questions with
a grade of 1 or more are scored; one without a run scores 0. Everything is a
join on (qid, did) and sums per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: regression gates
GATE = {"ndcg": 0.05, "recall": 0.05}
KIND_DROP, KIND_QUESTIONS, KIND_P = 0.03, 10, 0.05
JUDGED_LEAST = 0.90


def _gain(grade: Column, least: int) -> Column:
    return F.when(grade >= least, grade.cast("double")).otherwise(0.0)


def _discounted(grade: Column, rank: Column, least: int) -> Column:
    return _gain(grade, least) / F.log2(rank + 1)


def per_query(runs: DataFrame, qrels: DataFrame, k: int = 10, least: int = 1) -> DataFrame:
    """qid, ndcg, recall, mrr, judged, condensed at ``k``; grades under ``least``
    are no gain and not relevant."""
    judged = runs.select("qid", "did", "rank").join(qrels.select("qid", "did", "grade"), ["qid", "did"], "left")
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade")))
    want = (
        qrels.withColumn("i", ideal_rank).groupBy("qid")
        .agg(
            F.sum(F.when(F.col("i") <= k, _discounted(F.col("grade"), F.col("i"), least))).alias("ideal"),
            F.count_if(F.col("grade") >= least).alias("n_rel"), F.max("grade").alias("top"),
        )
        .where("top >= 1")
    )
    known = F.col("grade").isNotNull()
    short = F.when(known, F.count(F.when(known, 1)).over(Window.partitionBy("qid").orderBy("rank")))
    got = (
        judged.withColumn("short", short).groupBy("qid")
        .agg(
            F.sum(F.when(F.col("rank") <= k, _discounted(F.col("grade"), F.col("rank"), least))).alias("dcg"),
            F.sum(F.when(F.col("short") <= k, _discounted(F.col("grade"), F.col("short"), least))).alias("short_dcg"),
            F.count_if((F.col("rank") <= k) & (F.col("grade") >= least)).alias("hits"),
            F.min(F.when((F.col("rank") <= k) & (F.col("grade") >= least), F.col("rank"))).alias("first"),
            F.count_if((F.col("rank") <= k) & known).alias("n_judged"), F.count_if(F.col("rank") <= k).alias("n_back"),
        )
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)

    return want.join(got, "qid", "left").select(
        "qid", share("dcg", "ideal").alias("ndcg"), share("hits", "n_rel").alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), share("n_judged", "n_back").alias("judged"),
        share("short_dcg", "ideal").alias("condensed"),
    )


def paired(current: DataFrame, base: DataFrame, metric: str) -> DataFrame:
    """qid, diff of the questions both runs scored."""
    return current.select("qid", F.col(metric).alias("a")).join(base.select("qid", F.col(metric).alias("b")), "qid").select(
        "qid", (F.col("a") - F.col("b")).alias("diff")
    )


def verdict(compared: DataFrame, judged: Column, same_labels: Column) -> DataFrame:
    """One row: inconclusive unless the labels are the same (null: unknown, which
    does not block) and nine tenths of the results judged, else fail or pass."""
    blocked = ~F.coalesce(same_labels, F.lit(True)) | (judged < JUDGED_LEAST)
    return compared.agg(F.coalesce(F.bool_or("fails_gate"), F.lit(False)).alias("failed")).select(
        F.when(blocked, "inconclusive").when(F.col("failed"), "fail").otherwise("pass").alias("status")
    )


def labels_hash(qrels: DataFrame, buckets: int = 4096) -> DataFrame:
    """One sha256 over the judgments in order of question and document; hashed by
    question, then over ranges of questions, so no task orders them all."""
    line = F.concat_ws("\t", F.col("qid").cast("string"), F.col("did").cast("string"), F.col("grade").cast("string"))
    one = qrels.groupBy("qid").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    some = one.groupBy(F.pmod(F.xxhash64("qid"), F.lit(buckets)).alias("part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.col("qid").cast("string"), "h"))), "\n"), 256).alias("h")
    )
    return some.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("labels_sha"))

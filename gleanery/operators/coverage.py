"""Coverage of a question by its hits: how likely they are relevant, from how many
independent places, how fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: provisional curve (similarity, probability) and the rules per
# tier (least probability of the best hit, of a strong hit, strong hits needed,
# what makes two hits distinct)
CURVE = ((0.40, 0.00), (0.50, 0.15), (0.57, 0.35), (0.60, 0.45), (0.65, 0.60), (0.70, 0.70), (0.76, 0.80), (0.85, 0.95), (0.92, 1.00))
RULES = {
    "low": (0.35, 0.50, 2, "hit"),
    "medium": (0.45, 0.60, 2, "document"),
    "high": (0.45, 0.70, 2, "source"),
}
DEFAULT_TIER = "medium"
SHIFTS = tuple(round(-0.12 + 0.02 * i, 2) for i in range(13))
MAX_ANSWERED, MAX_REFUSED = 0.10, 0.15


def _of_tier(tier: Column, place: int) -> Column:
    out = F.lit(RULES[DEFAULT_TIER][place])
    for name, rule in RULES.items():
        out = F.when(tier == name, F.lit(rule[place])).otherwise(out)
    return out


def levels(hits: DataFrame, by: list[str]) -> DataFrame:
    """by..., level, n_strong, newest_year of the groups of hits.

    ``hits`` has item_id, doc_id, source_id, series, p (probability, null where
    the similarity is unknown), best (a closer similarity known to the search,
    or null), tier, year. No hit of known probability is level ``none``."""
    strong = F.col("p") >= _of_tier(F.col("tier"), 1)
    kind = _of_tier(F.col("tier"), 3)
    voice = (
        F.when(kind == "document", F.struct(F.col("doc_id").cast("string").alias("a"), F.lit("").alias("b")))
        .when(kind == "source", F.struct(F.coalesce("source_id", F.col("doc_id").cast("string")).alias("a"), F.coalesce("series", F.lit("")).alias("b")))
        .otherwise(F.struct(F.col("item_id").cast("string").alias("a"), F.lit("").alias("b")))
    )
    live = F.col("p") >= RULES["low"][0]
    return (
        hits.groupBy(*by)
        .agg(
            F.greatest(F.max("p"), F.max("best")).alias("top"), F.max("tier").alias("tier"),
            F.countDistinct(F.when(strong, voice)).alias("n_strong"), F.max(F.when(live, F.col("year"))).alias("newest_year"),
        )
        .withColumn(
            "level",
            F.when(F.col("top").isNull() | (F.col("top") < _of_tier(F.col("tier"), 0)), "none")
            .when(F.col("n_strong") >= _of_tier(F.col("tier"), 2), "strong").otherwise("partial"),
        )
        .select(*by, "level", "n_strong", "newest_year")
    )


def combined(by_domain: DataFrame, qid: str) -> DataFrame:
    """qid, level, weak: strong if every domain is, none if all are, else partial;
    weak are the domains below the best."""
    order = F.when(F.col("level") == "strong", 2).when(F.col("level") == "partial", 1).otherwise(0)
    ranked = by_domain.withColumn("o", order).withColumn("best", F.max("o").over(Window.partitionBy(qid)))
    return ranked.groupBy(qid).agg(
        F.when(F.min("o") == 2, "strong").when(F.max("o") == 0, "none").otherwise("partial").alias("level"),
        F.array_sort(F.collect_set(F.when(F.col("o") < F.col("best"), F.col("domain")))).alias("weak"),
    )


def with_empty(by_domain: DataFrame, asked: DataFrame, qid: str) -> DataFrame:
    """Domains asked for (qid, domain) that have no hits count as none."""
    return asked.join(by_domain, [qid, "domain"], "left").withColumn("level", F.coalesce("level", F.lit("none")))


def stale(newest_year: Column, this_year: int, half_life_days: Column) -> Column:
    """Whether the newest live hit is older than the half life; null is evergreen."""
    return F.coalesce((F.lit(this_year) - newest_year) * 365.25 > half_life_days, F.lit(False))


def sweep(questions: DataFrame, level_at) -> DataFrame:
    """shift, answered, refused: wrongful answers of gap questions and wrongful
    refusals of answerable ones for each shift of the curve; null without such
    questions.

    ``questions`` has is_gap and what ``level_at(shift column)`` needs."""
    shifts = F.explode(F.array(*[F.lit(s) for s in SHIFTS])).alias("shift")
    rows = questions.select("*", shifts)
    level = level_at(F.col("shift"))
    return rows.groupBy("shift").agg(
        F.try_divide(F.count_if(F.col("is_gap") & (level != "none")), F.count_if("is_gap")).alias("answered"),
        F.try_divide(F.count_if(~F.col("is_gap") & (level == "none")), F.count_if(~F.col("is_gap"))).alias("refused"),
    )


def recommended(rates: DataFrame) -> DataFrame:
    """The shift within both limits that refuses least, then answers least, then
    moves least; no row when none is."""
    return rates.where((F.col("answered") <= MAX_ANSWERED) & (F.col("refused") <= MAX_REFUSED)).orderBy(
        "refused", "answered", F.abs("shift"), "shift"
    ).limit(1)

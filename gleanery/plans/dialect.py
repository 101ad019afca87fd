"""Declarative plans written once in SQL.

A plan is a query text with ``{table}`` placeholders and a few bracketed
functions whose spelling differs between engines. ``plan`` turns it into the
Spark callable, where the placeholders are DataFrames and Catalyst plans the
text, and the twin text for an independent engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import table

#: name -> (Spark, twin); $1.. are the arguments, parted by ¦.
FUNCTIONS = {
    "epoch": ("unix_timestamp($1)", "CAST(floor(epoch($1)) AS BIGINT)"),
    "millis": ("unix_millis($1)", "epoch_ms($1)"),
    "micros": ("unix_micros($1)", "epoch_us($1)"),
    "month": ("date_format($1, 'yyyy-MM')", "strftime($1 AT TIME ZONE 'UTC', '%Y-%m')"),
    "year": ("year($1)", "year($1 AT TIME ZONE 'UTC')"),
    "sha": ("sha2($1, 256)", "sha256($1)"),
    "replace": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "extract": ("regexp_extract($1, $2, 1)", "regexp_extract($1, $2, 1)"),
    "matches": ("($1 RLIKE $2)", "regexp_matches($1, $2)"),
    "findall": ("regexp_extract_all($1, $2, 0)", "regexp_extract_all($1, $2)"),
    "rows": ("explode($1)", "unnest($1)"),
    "size": ("size($1)", "len($1)"),
    "has": ("array_contains($1, $2)", "list_contains($1, $2)"),
    "distinct": ("array_distinct($1)", "list_distinct($1)"),
    "joined": ("array_join($1, $2)", "array_to_string($1, $2)"),
    "split": ("split($1, $2)", "string_split_regex($1, $2)"),
    "json": ("get_json_object($1, $2)", "json_extract_string($1, $2)"),
    "div": ("(($1) div ($2))", "(($1) // ($2))"),
    # places of the median and the 95th percentile of $1 ordered rows, half even
    "nth50": (
        "((($1) - 1) div 2 + CASE WHEN (($1) - 1) % 4 = 3 THEN 1 ELSE 0 END)",
        "((($1) - 1) // 2 + CASE WHEN (($1) - 1) % 4 = 3 THEN 1 ELSE 0 END)",
    ),
    "nth95": (
        "((($1) - 1) * 19 div 20 + CASE WHEN (($1) - 1) * 19 % 20 > 10 OR (($1) - 1) * 19 % 40 = 30 THEN 1 ELSE 0 END)",
        "((($1) - 1) * 19 // 20 + CASE WHEN (($1) - 1) * 19 % 20 > 10 OR (($1) - 1) * 19 % 40 = 30 THEN 1 ELSE 0 END)",
    ),
    "range": ("sequence($1, $2)", "generate_series($1, $2)"),
    "days": ("datediff($1, $2)", "date_diff('day', $2, $1)"),
    "date": ("to_date($1)", "CAST($1 AT TIME ZONE 'UTC' AS DATE)"),
    "num": ("try_cast($1 AS $2)", "TRY_CAST($1 AS $2)"),
    "isoyear": ("extract(yearofweek FROM $1)", "extract(isoyear FROM $1)"),
    "sorted": ("sort_array($1)", "list_sort($1)"),
    "tidy": ("lower(btrim($1, ' \t\n\r\u00a0'))", "lower(trim($1, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"),
    "list": ("collect_list($1)", "list($1)"),
    "at": ("element_at($1, $2)", "list_extract($1, $2)"),
}


def _calls(text: str, which: int) -> str:
    """Replace ``[[name:arg¦arg]]``, innermost first."""
    pattern = re.compile(r"\[\[(\w+):((?:(?!\[\[|\]\]).)*)\]\]", re.S)

    def put(m: re.Match) -> str:
        out = FUNCTIONS[m.group(1)][which]
        for i, arg in enumerate(m.group(2).split("¦"), 1):
            out = out.replace(f"${i}", arg.strip())
        return out

    while pattern.search(text):
        text = pattern.sub(put, text)
    return text


def plan(text: str, views: dict | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """Spark callable and twin text. ``views`` name inputs other than tables: a
    callable for Spark and the common table expressions of the twin."""
    views = views or {}
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    spark_text = _calls(text, 0)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(spark_text, **{n: views[n][0](spark, sf) if n in views else table(spark, sf, n) for n in names})

    run.__doc__ = next((x.strip("- \n") for x in text.strip().splitlines() if x.strip().startswith("--")), "")
    twin = _calls(re.sub(r"\{(\w+)\}", r"\1", text), 1)
    needed = ", ".join(views[n][1] for n in names if n in views)
    if needed:
        twin = re.sub(r"\bWITH ", lambda m: f"WITH {needed}, ", twin, count=1)
    return run, twin


def plans(texts: dict[str, str], views: dict | None = None) -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name, text in texts.items():
        queries[name], sql[name] = plan(text, views)
        queries[name].__name__ = name
    return queries, sql

"""Joins that stay even when a key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the small side up to which it is sent to the large one.
BROADCAST_ROWS = 200_000
SALTS = 32


def join_small(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``large`` joined with the rows of ``small`` (few columns, one row per key).

    A small side of checked size is broadcast. A larger one is copied ``SALTS``
    times, and the large side's rows of a key are dealt over the copies by
    ``spread``, so a hot key is shared by as many tasks."""
    if small.count() <= most:
        return large.join(F.broadcast(small), keys, how)
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")

"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_weight(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of rows with groups (one row for each key; ``weight``: how many of the ``total`` rows have it), without ``weight``.

    Keys with more than total / share rows are fewer than ``share``: these are broadcast, so their rows aren't exchanged. Rows without a key pass by.
    The others are joined as Spark sees fit, none of their keys being large.
    """
    heavy = F.col(weight) * share > F.lit(total)
    large, small = groups.filter(heavy).drop(weight), groups.filter(~heavy).drop(weight)
    marked = rows.join(F.broadcast(large.withColumn("_large", F.lit(True))), key, "left")
    done = marked.filter(F.col("_large") | F.col(key).isNull()).drop("_large")
    rest = rows.filter(F.col(key).isNotNull()).join(F.broadcast(large.select(key)), key, "left_anti").join(small, key, "left")
    return done.unionByName(rest)

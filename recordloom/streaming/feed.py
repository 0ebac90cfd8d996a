"""Feeds: keyed upserts of source rows in batches, with classified changes (as a stream: keyed.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str, time_variant: list[str] | None = None, update_only: bool = False) -> DataFrame:
    """The feed after a batch: new keys are added and known ones replaced by their last row, unless a later one is stored already.

    With ``update_only`` fields in ``time_variant`` (counts that differ from day to day) keep their stored value. A
    full-outer join on the key; the batch is reduced to a row for each key before it.
    """
    fields = [f for f in stored.columns if f != key]
    new = latest(incoming.select(*stored.columns), key, order).select(key, F.lit(True).alias("_new"), *(c(f).alias(f"_n_{f}") for f in fields))
    both = stored.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    newer = c("_new").isNotNull() & (c("_old").isNull() | (c(f"_n_{order}") >= c(order)))
    keep = lambda f: c("_old").isNotNull() if update_only and f in (time_variant or []) else F.lit(False)
    return both.select(key, *(F.when(newer & ~keep(f), c(f"_n_{f}")).otherwise(c(f)).alias(f) for f in fields))


def classify(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change: added, same, published (a forthcoming record got its year, or volume and number), retracted, changed."""
    o = old.select(key, F.lit(True).alias("_old"), *(c(f).alias(f"o_{f}") for f in fields))
    n = new.select(key, F.lit(True).alias("_new"), *(c(f).alias(f"n_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & c(f"o_{f}").eqNullSafe(c(f"n_{f}"))
    year: Column = (c("o_year") == "forthcoming") & (c("n_year") != "forthcoming") if "year" in fields else F.lit(False)
    if {"volume", "number"} <= set(fields):
        year = year | (c("o_volume").isNull() & c("o_number").isNull() & c("n_volume").isNotNull() & c("n_number").isNotNull())
    retracted = c("n_title").startswith("RETRACTED") & ~c("o_title").startswith("RETRACTED") if "title" in fields else F.lit(False)
    kind = F.when(c("_old").isNull(), "added").when(same, "same").when(F.coalesce(retracted, F.lit(False)), "retracted").when(F.coalesce(year, F.lit(False)), "published").otherwise("changed")
    return n.join(o, key, "left").select(key, kind.alias("change"))


def windowed_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows; on a stream, rows later than ``late`` are dropped and their state is freed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n")).select(c("w.start").alias("window_start"), *by, "n")

"""Order-dependent operators: change logs, transitions, ids, samples for coders, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.schema import transitions
from recordloom.session import materialize

c = F.col


def unique_suffix(n: Column) -> Column:
    """"" for 1, then a, b, ..., z, aa, ...: the suffix of the n-th record of a base id."""
    step = lambda a, _: F.when(a["k"] <= 0, a).otherwise(F.struct(F.floor((a["k"] - 1) / 26).cast("long").alias("k"), F.concat(F.char((97 + (a["k"] - 1) % 26).cast("int")), a["s"]).alias("s")))
    # fourteen letters number more than a long can hold
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct((n - 1).cast("long").alias("k"), F.lit("").alias("s")), step, lambda a: a["s"])


def unique_ids(records: DataFrame, base: Column, order: str = "seq") -> DataFrame:
    """ID, new_id: ids that differ without regard to case, in load order."""
    w = Window.partitionBy(F.lower("_base")).orderBy(order)
    return records.withColumn("_base", base).withColumn("_n", F.row_number().over(w)).select("ID", F.concat("_base", unique_suffix(c("_n"))).alias("new_id"))


def next_ids(known: DataFrame, new: DataFrame, key: str, width: int = 6) -> DataFrame:
    """Ids of feed rows: known keys keep theirs, others get the numbers after the largest, in the order of the key.

    known: key, id; new: key. Numbers are dealt by range: rows are counted per range partition first, so no task numbers all of them.
    """
    top = known.agg(F.max(c("id").try_cast("long")).alias("top"))
    fresh = new.select(key).distinct().join(known, key, "left_anti")
    parts = fresh.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    parts = materialize(parts, "next-ids")
    before = parts.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    numbered = parts.join(before.select("_p", "_before"), "_p").crossJoin(top).select(key, F.lpad((F.coalesce("top", F.lit(0)) + c("_before") + n).cast("string"), width, "0").alias("id"))
    return known.select(key, "id").unionByName(numbered)


def best_per_key(df: DataFrame, key: Column, score: str, tie: str, top: int) -> DataFrame:
    """The best row of each key, then the best ``top`` of those."""
    best = df.groupBy(key.alias("key")).agg(F.max(F.struct(c(score).alias("s"), (-c(tie)).alias("t"))).alias("b"))
    return best.select("key", c("b.s").alias("score"), (-c("b.t")).alias("tie")).orderBy(F.desc("score"), "tie").limit(top)


def change_log(snapshots: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """What each snapshot of a key changed against the one before: key, order, kind (new, changed, same), fields."""
    w = Window.partitionBy(key).orderBy(order)
    out = snapshots.withColumns({f"_p_{f}": F.lag(f).over(w) for f in fields}).withColumn("_n", F.row_number().over(w))
    changed = F.array_join(F.filter(F.array(*(F.when(~c(f).eqNullSafe(c(f"_p_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",")
    return out.select(key, order, F.when(c("_n") == 1, "new").when(changed == "", "same").otherwise("changed").alias("kind"), F.when(c("_n") == 1, "").otherwise(changed).alias("fields"))


def transitions_taken(history: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Each change of a key's state with the operation that makes it, or invalid_transition."""
    w = Window.partitionBy(key).orderBy(order)
    moved = history.withColumn("source", F.lag(state).over(w)).filter(c("source").isNotNull() & (c("source") != c(state))).select(key, order, "source", c(state).alias("dest"))
    t = transitions(history.sparkSession).groupBy("source", "dest").agg(F.min("operation").alias("operation"))
    return moved.join(t, ["source", "dest"], "left").select(key, order, "source", "dest", F.coalesce("operation", F.lit("invalid_transition")).alias("operation"))


def split_for_coders(records: DataFrame, coders: int, order: str = "ID") -> DataFrame:
    """ID, coder: slices of equal size in the order of the id; the remainder isn't dealt.

    The slice borders are ids at known positions, found by a range-partitioned count, so rows aren't numbered in one task.
    """
    parts = materialize(records.select(order).repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "coders")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(sizes.agg(F.sum("_c").alias("_total")))
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + c("_before")
    size = F.floor(c("_total") / coders)
    return parts.join(before.drop("_c"), "_p").select(order, F.floor(n / size).cast("int").alias("coder")).filter(c("coder") < coders)


def appended_only(versions: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Whether each version of a file begins with the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    return versions.withColumn("_b", F.lag(text).over(w)).select(key, order, F.coalesce(c(text).startswith(c("_b")), F.lit(True)).alias("appended"))

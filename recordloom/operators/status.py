"""Review status: counts by state, steps, active operations, closures of the state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.schema import POST, RANK, TRANSITIONS, states, transitions
from recordloom.session import materialize

# fixed values: steps of the review that a record in a state has behind it
STEPS_DONE = {
    "md_retrieved": 0, "md_imported": 1, "md_needs_manual_preparation": 1, "md_prepared": 2, "md_processed": 3, "rev_prescreen_excluded": 4, "rev_prescreen_included": 4,
    "pdf_needs_manual_retrieval": 4, "pdf_imported": 5, "pdf_not_available": 5, "pdf_needs_manual_preparation": 5, "pdf_prepared": 6, "rev_excluded": 7, "rev_included": 7, "rev_synthesized": 8,
}


def report(records: DataFrame) -> DataFrame:
    """state, state_rank, currently (records in it), overall (records that have passed it). One count by state, then small tables only."""
    spark = records.sparkSession
    now = records.groupBy("status").agg(F.count("*").alias("n"))
    passed = spark.createDataFrame([(x, s) for x, members in POST.items() for s in members], "passed string, status string")
    overall = passed.join(now, "status").groupBy("passed").agg(F.sum("n").alias("overall"))
    return (
        states(spark).join(now.withColumnRenamed("status", "state"), "state", "left").join(overall.withColumnRenamed("passed", "state"), "state", "left")
        .select("state", "state_rank", F.coalesce("n", F.lit(0)).alias("currently"), F.coalesce("overall", F.lit(0)).alias("overall"))
    )


def origin_list() -> Column:
    return F.split(F.col("origins"), ";")


def origin_statistics(records: DataFrame) -> DataFrame:
    """Origins that aren't metadata sources, and how many of them were merged into other records."""
    n = F.size(F.filter(origin_list(), lambda o: ~o.startswith("md_")))
    return records.agg(F.sum(n).cast("long").alias("origins"), F.sum(F.greatest(n - 1, F.lit(0))).cast("long").alias("duplicates_removed"))


def origin_states(records: DataFrame) -> DataFrame:
    """One row for each origin: origin, source, local_id, is_md, ID, status."""
    o = records.select("ID", "status", F.explode(origin_list()).alias("origin"))
    return o.select(
        "origin", F.split_part("origin", F.lit("/"), F.lit(1)).alias("source"), F.split_part("origin", F.lit("/"), F.lit(2)).alias("local_id"), F.col("origin").startswith("md_").alias("is_md"), "ID", "status"
    )


def screening_statistics(records: DataFrame) -> DataFrame:
    """Criterion, records that it excluded, records screened."""
    x = records.filter("screening_criteria is not null").select(F.explode(F.split("screening_criteria", ";")).alias("x"))
    return x.groupBy(F.split_part("x", F.lit("="), F.lit(1)).alias("criterion")).agg(
        F.count_if(F.split_part("x", F.lit("="), F.lit(2)) == "out").alias("excluded"), F.count("*").alias("screened")
    )


def atomic_steps(records: DataFrame, steps: int = 9) -> DataFrame:
    """Steps of the whole review and those completed."""
    done = F.create_map(*[F.lit(x) for kv in STEPS_DONE.items() for x in kv])
    return records.groupBy("status").agg(F.count("*").alias("n")).filter(F.col("status").isin(list(RANK))).agg(
        F.sum(F.col("n") * steps).alias("atomic_steps"), F.sum(F.col("n") * done[F.col("status")]).alias("completed")
    )


def curated_percentage(records: DataFrame) -> DataFrame:
    return records.agg(F.floor(F.lit(100.0) * F.count("curated") / F.greatest(F.count("*"), F.lit(1))).cast("int").alias("perc_curated"))


def active_operations(records: DataFrame) -> DataFrame:
    """Operations that some record waits for."""
    have = records.select("status").distinct()
    return transitions(records.sparkSession).join(have, F.col("source") == F.col("status"), "left_semi").select("operation").distinct()


def preceding_states(spark: SparkSession) -> DataFrame:
    """(state, before): all states from which a state is reached. The transition table has 17 rows; its closure takes a few doublings."""
    reach = transitions(spark).select(F.col("dest").alias("state"), F.col("source").alias("before")).distinct()
    for _ in range(4):  # paths of up to 16 transitions
        step = reach.alias("a").join(reach.alias("b"), F.col("a.before") == F.col("b.state")).select("a.state", "b.before")
        reach = materialize(reach.union(step).distinct(), "closure")
    return reach



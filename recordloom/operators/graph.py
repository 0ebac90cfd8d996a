"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.session import materialize, release, table_of, with_table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: rows (node, component), where component is
    the smallest node of the component.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of
    the component size. Every round is two group-minimum aggregations joined back on their key, so a
    node with very many neighbours is split by the skew join and never gathered. Lineage is cut by
    a written table each round, whose count and checksum are taken as it is written. Null ends and loops are ignored; repeated edges count once.
    """
    e = (
        edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = materialize(e, "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: every edge now points from a larger node (u) to a smaller one (v)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = (
            moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        seal = Observation()
        before, e = e, materialize(small.observe(seal, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "cc")
        release(before)
        now = (seal.get["n"], seal.get["sum"])
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("connected_components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    return with_table(out, table_of(e))

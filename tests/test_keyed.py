"""Keyed state on streams: late, repeated and unordered rows, a restart in the middle, bounded state, sources that only grow."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recordloom.streaming import keyed

SCHEMA = "k string, t long, v string, w double, ts timestamp"
START = datetime(2024, 1, 1)


def write(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/b={number:03d}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/b=*")


def run(spark, folder, **how):
    q = keyed.append_log(keyed.feed_changes(stream(spark, folder), "k", "t", ["v", "w"], **how), f"{folder}/log", f"{folder}/state")
    q.awaitTermination()
    return q


def log(spark, folder):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/log").collect()), key=str)


def last(rows):
    out = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and (r[0] not in out or r[1] >= out[r[0]][1]):
            out[r[0]] = r
    return {k: r[1:4] for k, r in out.items()}


def test_feed_through_a_restart(spark, tmp_path):
    """Rows out of order and brought again, a second start from the checkpoint: the log's last rows are the batch's."""
    folder, rng = str(tmp_path), random.Random(1)
    rows = [(f"k{rng.randint(0, 9)}" if i % 13 else None, i if i % 17 else None, rng.choice("abc"), float(rng.randint(0, 2)), START + timedelta(minutes=i)) for i in range(120)]
    rng.shuffle(rows)
    for b in range(3):
        write(spark, folder, b, rows[b * 30 : b * 30 + 30])
    run(spark, folder)
    write(spark, folder, 3, rows[90:])
    write(spark, folder, 4, rows[:40])  # again
    q = run(spark, folder)
    got = {r.k: (r.t, r.v, r.w) for r in keyed.latest_of_log(spark, f"{folder}/log", "k", "t").collect()}
    assert got == last(rows)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == len(got)
    changes = log(spark, folder)
    assert sum(c[1] == "added" for c in changes) == len(got) and len({(c[0], c[2]) for c in changes}) == len(changes)
    assert run(spark, folder).lastProgress is None or log(spark, folder) == changes  # nothing new, nothing written


def test_kinds_of_change(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, 0, [("a", 1, "x", 1.0, START), ("b", 5, "y", None, START)])
    write(spark, folder, 1, [("a", 2, "x", 1.0, START), ("b", 4, "z", 2.0, START), (None, 9, "n", 0.0, START), ("c", None, "n", 0.0, START)])
    write(spark, folder, 2, [("a", 3, "z", 1.0, START), ("b", 6, "y", None, START)])
    run(spark, folder)
    assert log(spark, folder) == [("a", "added", 1, "x", 1.0), ("a", "changed", 3, "z", 1.0), ("a", "same", 2, "x", 1.0), ("b", "added", 5, "y", None), ("b", "same", 6, "y", None)]


def test_idle_keys_free_their_state(spark, tmp_path):
    """A key a file, an hour apart: with a watermark the state holds the keys of the last hours only, and rows behind it are dropped."""
    folder = str(tmp_path)
    for i in range(8):
        write(spark, folder, i, [(f"k{i}", i, "x", 0.0, START + timedelta(hours=i))])
    write(spark, folder, 8, [("late", 99, "x", 0.0, START)])
    q = run(spark, folder, event_time="ts", late="10 minutes", idle_ms=90 * 60_000)
    assert {r[0] for r in log(spark, folder)} == {f"k{i}" for i in range(8)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none") != keyed.PROVIDER[1]
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 40
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert rows[-1] <= max(rows) and rows[-1] < 8 * 3


@pytest.mark.parametrize("one_batch", [True, False])
def test_sources_only_grow(spark, tmp_path, one_batch):
    rows = {
        "1": [("s", "a", "T", 1), ("s", "b", "U", None), ("q", "a", "V", 2), (None, "z", "V", 2), ("s", None, "V", 2)],
        "2": [("s", "a", "T", 1), ("s", "b", "U2", None), ("s", "c", "W", 3), ("s", "c", "W", 3)],
        "3": [("s", "b", "U", None), ("q", "a", "V", 3)],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, "source string, local_id string, title string, year int").coalesce(1).write.parquet(str(tmp_path / f"in/export={name}"))
    src = spark.readStream.schema("source string, local_id string, title string, year int, export string").option("maxFilesPerTrigger", 100 if one_batch else 1).parquet(str(tmp_path / "in"))
    q = keyed.append_log(keyed.append_only_changes(src.withColumn("_file", F.col("export")), ["title", "year"]), str(tmp_path / "log"), str(tmp_path / "state"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log")).groupBy("source", "local_id", "change").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == [
        ("q", "a", "added", 1), ("q", "a", "violation", 1), ("s", "a", "added", 1), ("s", "a", "repeated", 1), ("s", "b", "added", 1), ("s", "b", "repeated", 1), ("s", "b", "violation", 1), ("s", "c", "added", 1), ("s", "c", "repeated", 1),
    ]

"""Faults found in round 3: each test failed before."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions import similarity
from recordloom.functions.similarity import best_window_ratio, lcs_length, lcs_lengths
from recordloom.operators import dedupe as D
from recordloom.plans.catalogue import oracle_sql, queries
from tests.test_oracle import norm

RAW_TITLES = [
    "D11_unmerged_records", "F12_polish_mostly_upper", "F18_unescape_latex", "F20_standardise_title", "F21_polish_acronyms", "F23f_clean_characters", "P17_last_round", "P21_language_filter",
    "S13_csv_round_trip", "S13_workbooks", "S14_json_round_trip", "S16_unique_check", "X1_registered_works", "X2_papers",
]


@pytest.fixture(scope="module")
def sharp(spark, tmp_path_factory):
    """English documents in capitals (7 of each 60) whose titles hold letters with capitals of several characters."""
    path = str(tmp_path_factory.mktemp("sharp"))
    heads = ["Straße and more", "ß first", "ﬁne ŉ ΰ ᾀ", "plain"]
    text = "element_at(array({}), cast(id div 60 % 4 + 1 as int)) || '\n' || repeat('a text of words and more ', 3)".format(", ".join(f"'{h}'" for h in heads))
    spark.range(7, 1000, 60).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", RAW_TITLES)
def test_capitals_are_those_of_the_sql(spark, sharp, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sharp}/documents.parquet/*.parquet'")
    df = queries()[name](spark, sharp)
    cols = sorted(df.columns)
    want = duck.sql(oracle_sql()[name])
    at = [want.columns.index(x) for x in cols]
    assert sorted(tuple(norm(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_upper_letter(spark):
    df = spark.createDataFrame([(x,) for x in (*T.GROWING, "a", "é", "1")], "x string")
    assert "".join(r.u for r in df.select(T.upper_letter(F.col("x")).alias("u")).collect()) == T.CAPITALS + "AÉ1"


def test_lcs_lengths_are_those_of_single_pairs():
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcdefg ß😀") for _ in range(rng.choice((0, 1, 62, 63, 64, 126, 200, rng.randint(0, 300)))))
    texts = [text() for _ in range(70)]
    pairs = [(x, y) for x in texts for y in texts]
    assert lcs_lengths(*(list(x) for x in zip(*pairs))).tolist() == [lcs_length(*p) for p in pairs]


@pytest.mark.parametrize("tile", [3, 1000])
def test_a_key_of_many_records_is_dealt_to_tiles(spark, tile):
    """Pairs of one key reach several partitions, each pair once; rows without a partner and other keys are left alone."""
    rows = [(f"R{i:02d}", "hot" if i < 20 else f"k{i % 3}") for i in range(30)] + [("R99", None)]
    df = spark.createDataFrame(rows, "ID string, key string")
    side = lambda n: df.select(F.col("ID").alias(f"{n}_ID"), F.col("key").alias(f"{n}_key"))
    got = D.tiled_pairs(side("a"), side("b"), ["key"], tile).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.a_ID, r.b_ID) for r in got) == sorted((x, y) for x, k in rows for y, m in rows if x < y and k == m and k)
    assert (len({r.p for r in got if r.a_key == "hot"}) > 1) == (tile < 20)


def test_one_key_needs_no_second_exchange_of_pairs(spark):
    """Pairs of one kind of key are met once: wide pairs aren't grouped."""
    df = spark.createDataFrame([("R1", "x"), ("R2", "x")], "ID string, k string")
    pairs = D.pairs_on(df, {"k": F.col("k")}, ["ID"])
    assert pairs.collect() == [("R1", "R2", ["k"])]
    assert "collect_set" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_contained_text_needs_no_grid(monkeypatch):
    """A title that stands in its abstract has a window alike: no strands are combed, and others have the same ratio as before."""
    monkeypatch.setattr(similarity, "window_strands", None)
    assert best_window_ratio("a title", "with a title in it") == best_window_ratio("with a title in it", "a title") == best_window_ratio("x", "x") == 100.0

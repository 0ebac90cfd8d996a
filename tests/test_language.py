"""Languages of titles on held-out documents."""

from pyspark.sql import functions as F

from recordloom.operators.language import fit_profiles, tell_languages, trigrams

SF = "/root/testdata/sf0.01"


def test_trigrams(spark):
    rows = spark.createDataFrame([(1, "Ab, ab c!"), (2, None), (3, "12 -"), (4, "x" * 500)], "id int, text string")
    assert sorted((r.id, r.gram, r.n) for r in trigrams(rows, ["id"]).collect()) == [(1, " ab", 2), (1, " c ", 1), (1, "ab ", 2)]


def test_held_out_titles(spark):
    """Profiles of one half of the documents tell the titles of the other; letters at random and other languages belong to none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null and lang is not null")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    profiles = fit_profiles(docs.filter(train).select("lang", "text"))
    titles = docs.filter(~train).select("doc_id", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")).filter(F.char_length("text").between(60, 400) & ~F.col("text").rlike(r"[!$%&*#|]{2}|\|"))
    told = tell_languages(titles, profiles, ["doc_id"]).withColumnRenamed("lang", "told").join(titles, "doc_id")
    n, right, wrong = told.agg(F.count("*"), F.count(F.when(F.col("told") == F.col("lang"), 1)), F.count(F.when(F.col("told") != F.col("lang"), 1))).first()
    assert n > 150 and right >= 0.95 * n and wrong <= 0.03 * n
    other = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar", "qzx wvkj xqpt zzgh jkwq vvbn qxwz kjhg", "Все люди рождаются свободными и равными в своем достоинстве"]
    got = tell_languages(spark.createDataFrame(list(enumerate(other)), "doc_id int, text string"), profiles, ["doc_id"]).collect()
    assert len(got) == len(other) and all(r.lang is None for r in got)
    assert tell_languages(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"), profiles, ["doc_id"]).collect() == []

"""Large files read in byte ranges by many tasks: the same records as from whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators.history import unique_suffix
from recordloom.sources import formats


def words(rng):
    return " ".join(rng.choice(["über", "data", "of", "systems", "–", "naïve", "R&D"]) for _ in range(rng.randint(1, 40)))


def bib(rng, i):
    head = rng.choice(["@article{", "@Book {", "  @misc{"]) + f"K{i},\n"
    return head + f"  title = {{A {{Nested}} {words(rng)}\n    over {i} lines}},\n  author = {{Smith, A and\n Lee, K}},\n  year = {1990 + i % 30}\n}}\n" + rng.choice(["", "\n", "\n\n% a remark\n"])


def ris(rng, i):
    return f"TY  - {rng.choice(['JOUR', 'CONF', 'BOOK'])}\nID  - K{i}\nAU  - Smith, A\nAU  - Lee, K\nTI  - {words(rng)} {i}\nSP  - 1\nEP  - {i}\nER  - \n" + rng.choice(["", "\n", "\n\n"])


def nbib(rng, i):
    return f"PMID- {i}\nTI  - {words(rng)}\n      and {i}\nPT  - Journal Article\nAU  - Lee K\n\n"


def nbib_own(rng, i):
    return f"OWN - LIB\nTI  - {words(rng)} {i}\nOID - E{i}\n\n"


def enl(rng, i):
    return f"%0 Journal Article\n%T {words(rng)} {i}\n%A Lee, K\n%D {1990 + i % 30}\n\n"


CASES = {"bib": (bib, "% Encoding: UTF-8\n@comment{x}\n@string{a = {b}}\n"), "ris": (ris, "Provider: A library\nDatabase: B\n\n"), "nbib": (nbib, ""), "own.nbib": (nbib_own, ""), "enl": (enl, "")}


@pytest.mark.parametrize("kind", list(CASES))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_a_file(spark, tmp_path, kind, end):
    rng = random.Random(len(kind))
    make, before = CASES[kind]
    text = "﻿" + before + "".join(make(rng, i) for i in range(2000))
    path = str(tmp_path / f"large.{kind}")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text.replace("\n", end))
    suffix = kind.rsplit(".", 1)[-1]
    whole = [(r.ENTRYTYPE, r.local_id, r.fields) for r in formats.load_text(spark, text, suffix).orderBy("seq").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = formats.load(spark, path)
        assert df.rdd.getNumPartitions() > 10
        got = df.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.seq for r in got}) == len(got) == 2000 and {r.source for r in got} == {f"large.{kind}"}
    assert [(r.ENTRYTYPE, r.local_id, r.fields) for r in got] == whole


def test_small_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.bib").write_text("")
    assert formats.load(spark, str(tmp_path / "empty.bib")).collect() == []
    (tmp_path / "none.ris").write_text("nothing here\n")
    assert formats.load(spark, str(tmp_path / "none.ris")).collect() == []
    (tmp_path / "one.ris").write_text("TY - JOUR\nTI - One space\nER -\n\nTY - BOOK\nTI - Two\nER -")
    assert [(r.ENTRYTYPE, r.fields) for r in formats.load(spark, str(tmp_path / "one.ris")).orderBy("seq").collect()] == [("article", {"title": "One space"}), ("book", {"title": "Two"})]


def test_unique_suffixes(spark):
    def by_hand(n):
        out = ""
        k = n - 1
        while k > 0:
            k, r = divmod(k - 1, 26)
            out = chr(97 + r) + out
        return out

    ns = [1, 2, 3, 27, 28, 703, 704, 18_279, 18_280, 400_000, 12_356_631, 10**15]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", unique_suffix(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: by_hand(n) for n in ns}
    assert spark.range(1, 20_001).select(unique_suffix(F.col("id")).alias("s")).distinct().count() == 20_000

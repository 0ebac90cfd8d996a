"""Faults of size found in round 3's second reading: each test failed before."""

import random

from pyspark.sql import functions as F

from recordloom.functions.similarity import indel_ratio
from recordloom.operators import dedupe, lookup, reports, transfer
from recordloom.operators.similar import classes, similar_between


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_citations_are_counted_before_they_are_spread(spark):
    """a row for each number of mentions is made of a reference's counts, not of its citations; citations without a reference count as one."""
    rows = [("a", 3), ("a", 25), ("a", 1), ("b", 0), (None, 2), (None, 19)]
    grid = reports.threshold_grid(spark.createDataFrame(rows, "ref string, n_intext int").withColumn("paper", F.lit("p")))
    counts = {"a": [3, 25, 1], None: [2, 19]}
    want = {(i, j): sum(sum(n >= i for n in c) >= j for c in counts.values()) for i in range(1, 20) for j in range(1, 4)}
    assert {(r.i, r.j): r.n for r in grid.collect()} == {k: n for k, n in want.items() if n}
    plan = logical(grid)
    assert plan.rindex("Generate explode") < plan.rindex("Aggregate [ref")


def asked_of(monkeypatch, module):
    """What a module's similarity joins are asked: (rows of one side, rows of the other) of each."""
    seen = []

    def join(asked, index, threshold):
        seen.append((asked.count(), index.count()))
        return similar_between(asked, index, threshold)

    monkeypatch.setattr(module, "similar_between", join)
    return seen


def test_sets_are_numbers_when_they_are_joined(spark):
    """tokens are of one size whatever the words, and sets alike in their words are one."""
    members, entities = classes(spark.createDataFrame([("R1", ["a" * 1000, "b"]), ("R2", ["b", "a" * 1000, "b"]), ("R3", ["c"])], "ID string, tokens array<string>"))
    assert dict(entities.dtypes)["tokens"] == "array<bigint>"
    assert sorted((r.entity, r.ID) for r in members.collect()) == [("R1", "R1"), ("R1", "R2"), ("R3", "R3")]


def test_copies_of_a_title_ask_once(spark, monkeypatch):
    """records of one title meet metadata of one title as one pair, and all of them get the smallest DOI's fields."""
    seen = asked_of(monkeypatch, transfer)
    title = "a title of five words"
    r = spark.createDataFrame([(f"R{i}", title if i % 2 else title.upper(), None, None) for i in range(20)] + [("S1", "something else", None, "1")], "ID string, title string, doi string, year string")
    m = spark.createDataFrame([(title.title(), f"10.1/{i}", str(2000 + i)) for i in range(9, 0, -1)], "title string, doi string, year string")
    got = {(x.ID, x.doi, x.year, x.via) for x in transfer.enrich_records(r, m, ["year"]).collect()}
    assert got == {(f"R{i}", "10.1/1", "2001", "title") for i in range(20)} | {("S1", None, "1", None)}
    assert seen == [(2, 1)]


def test_records_found_by_title_need_no_duplicate(spark, monkeypatch):
    """only records whose issue is known without their title are compared with the issue's records."""
    seen = asked_of(monkeypatch, lookup)
    row = lambda x, title, volume="1": (x, int(x[1:]), "article", title, "Meyer, A.", "Journal", None, volume, "1", "2001")
    schema = "ID string, seq long, ENTRYTYPE string, title string, author string, journal string, booktitle string, volume string, number string, year string"
    index = spark.createDataFrame([row(f"I{i}", "one title of many records") for i in range(10)], schema)
    asked = spark.createDataFrame([row(f"A{i}", "one title of many records") for i in range(10, 30)] + [row("A1", "one title of very many records"), row("A2", "nothing like it"), row("A3", "one title", "2")], schema)
    got = {r.ID: (r.index_id, r.result) for r in lookup.toc_status(asked, index).collect()}
    assert got == {f"A{i}": ("I0", "found") for i in (1, *range(10, 30))} | {"A2": (None, "not-in-toc"), "A3": (None, "not-in-index")}
    assert seen == [(2, 10)]


def test_titles_of_an_issue_are_dealt_to_tiles(spark):
    """pairs of one issue are met in several partitions, and none is lost, whatever its characters."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abc déß😀") for _ in range(60)) for _ in range(4)]
    titles = [b[:i] + x + b[i + rng.randint(0, 3) :] for b in base for i in (0, 7, 30, 59) for x in ("", "z", "😀ß", "qqqq")] + ["", "", "x", None]
    rows = [(f"R{i:03d}", "article", t, "Journal", None, "1", "1", None) for i, t in enumerate(titles)]
    r = spark.createDataFrame(rows, "ID string, ENTRYTYPE string, title string, journal string, booktitle string, volume string, number string, year string")
    got = {(x.a_ID, x.b_ID): x.sim for x in dedupe.alike_titles(r).collect()}
    pairs = {(f"R{i:03d}", f"R{j:03d}"): round(indel_ratio(s.lower(), t.lower()), 4) for i, s in enumerate(titles) for j, t in enumerate(titles) if i < j and s is not None and t is not None}
    assert got == {p: x for p, x in pairs.items() if x > 95} and len(got) > 20
    assert "_tile" in logical(dedupe.alike_titles(r))

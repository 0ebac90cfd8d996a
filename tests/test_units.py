"""Single operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions.names import parse_name
from recordloom.functions.similarity import best_window_ratio, indel_ratio, lcs_length
from recordloom.operators import dedupe, fulltext, history, lookup, quality, reports
from recordloom.operators.graph import connected_components
from recordloom.sources import formats
from recordloom.streaming import feed

FIELDS = ["ENTRYTYPE", "title", "author", "year", "journal", "booktitle", "volume", "number", "pages", "publisher", "school", "url", "doi", "isbn", "language", "abstract", "keywords", "pubmedid", "curated"]


def record(spark, **values):
    row = {"ENTRYTYPE": "article", "title": "A title of some length", "author": "Smith, John and Lee, Kim", "year": "2020", "journal": "Journal of Things", "volume": "1", "number": "2", "language": "eng"} | values
    return spark.createDataFrame([("R1", 1, *(row.get(f) for f in FIELDS))], "ID string, seq int, " + ", ".join(f"{f} string" for f in FIELDS))


@pytest.mark.parametrize(
    ("values", "defect"),
    [
        ({}, None),
        ({"volume": None}, ("volume", "missing")),
        ({"volume": None, "number": None, "year": "forthcoming"}, ("year", "year-format")),
        ({"title": "Something that ends..."}, ("title", "incomplete-field")),
        ({"author": "Smith, John, and Lee"}, ("author", "incomplete-field")),
        ({"author": "{Open Group}"}, ("author", "name-format-separators")),
        ({"title": "ALL IN CAPITALS HERE"}, ("title", "mostly-all-caps")),
        ({"journal": "MISQ"}, ("journal", "container-title-abbreviated")),
        ({"journal": "PLOS ONE"}, None),
        ({"title": "The Journal of Things"}, ("title", "identical")),
        ({"doi": "5.1234/x"}, ("doi", "doi-not-matching-pattern")),
        ({"isbn": "no isbn"}, ("isbn", "isbn-not-matching-pattern")),
        ({"isbn": "978-3-16-148410-0", "ENTRYTYPE": "book", "journal": None, "number": None, "publisher": "P"}, None),
        ({"pages": "20--10"}, ("pages", "page-range")),
        ({"pages": "10--20"}, None),
        ({"language": "en"}, ("language", "language-format-error")),
        ({"author": "von Berg, Max"}, ("author", "name-particles")),
        ({"author": "Lee, Kim and others"}, ("author", "name-abbreviated")),
        ({"booktitle": "Proceedings"}, ("booktitle", "inconsistent-with-entrytype")),
        ({"abstract": "Caf&#233;"}, ("abstract", "html-tags")),
        ({"volume": None, "curated": "CURATED"}, None),
    ],
)
def test_defects(spark, values, defect):
    got = {(r.field, r.code) for r in quality.defect_rows(record(spark, **values)).collect()}
    if defect is None:
        assert got == set()
    elif defect[1] == "identical":
        assert ("journal", "identical-values-between-title-and-container") in got
    else:
        assert defect in got


def test_fatal_defects_decide_the_state(spark):
    state = lambda **v: record(spark, **v).select(quality.set_prepared()).first()[0]
    assert state() == "md_prepared"
    for bad in ({"title": None}, {"author": "UNKNOWN"}, {"journal": None}, {"title": "doi:10.1/x"}, {"title": "12345 a"}, {"title": "Journal of Things"}):
        assert state(**bad) == "md_needs_manual_preparation"


def test_lcs_and_ratios():
    rng = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    assert indel_ratio("", "") == 100 and indel_ratio("rai a", "rai arun") == pytest.approx(200 * 5 / 13)
    assert best_window_ratio("abc", "xxabcxx") == 100 and best_window_ratio("", "") == 100


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Donald E. Knuth", ("Donald E.", None, "Knuth", None)),
        ("Ludwig van der Berg", ("Ludwig", "van der", "Berg", None)),
        ("von Last, Jr, First", ("First", "von", "Last", "Jr")),
        ("de la Cruz, Ana Maria", ("Ana Maria", "de la", "Cruz", None)),
        ("{Open Source Group}", (None, None, "{Open Source Group}", None)),
        ("Plato", (None, None, "Plato", None)),
        ("", (None, None, None, None)),
    ],
)
def test_names(name, want):
    got = parse_name(name)
    assert (got["first"], got["von"], got["last"], got["jr"]) == want


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A title</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>J</forename><surname>Smith</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>What it   is about.</p></abstract><textClass><keywords><term>one</term><term>two</term></keywords></textClass></profileDesc></teiHeader>
<text><body><div><p>Short.</p><p>This paragraph has more than forty characters in it.</p></div></body><back><listBibl><biblStruct xml:id="b0"><analytic><title>Cited</title></analytic><monogr><imprint><date when="2001-05"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    got = {r.id: r for r in fulltext.tei_documents(spark.createDataFrame([("a", TEI), ("b", "<broken"), ("c", None)], "id string, xml string")).collect()}
    a = got["a"]
    assert (a.title, a.abstract, a.keywords, a.authors, a.error) == ("A title", "What it is about.", ["one", "two"], ["Smith, J."], None)
    assert a.paragraphs == ["This paragraph has more than forty characters in it."] and [tuple(r) for r in a.references] == [("b0", "Cited", "2001")]
    assert got["b"].error and got["c"].error and got["b"].title is None


def test_similarity_of_known_pair(spark):
    a = {"title": "EDITORIAL", "author": "Rai, Arun", "year": "2020", "journal": "MIS Quarterly", "volume": "45", "number": "1", "pages": "1--3"}
    r = record(spark, **a).unionAll(record(spark, **(a | {"author": "Rai, A", "journal": "MISQ"})).withColumn("ID", F.lit("R2")))
    d = dedupe.comparable(r)
    pairs = dedupe.pairs_on(d, {"volume": F.col("volume")}, ["ID", *(c for c in d.columns if c.startswith("s_"))])
    assert [x.similarity for x in dedupe.pair_similarity(pairs).collect()] == [0.9074]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(80)] + [(7, 7), (None, 3)] + [(900, 901 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


BIB = """% comment
@article{Smith2020,
   author  = {Smith, John and M{\\"u}ller, Anna},
   title   = {A {Nested} title
              over lines},
   year    = 2020,
   journal = "Journal of Things",
   my.key  = {x},
}
@comment{ignored}

@www{web1, title = {Page}}
"""
RIS = "TY  - JOUR\nAU  - Smith, J\nAU  - Lee, K\nTI  - One\nSP  - 1\nEP  - 9\nKW  - a\nKW  - b\nER  - \n\nTY  - CONF\nTI  - Two\nT2  - Meeting\nID  - 7\nER  - \n"
NBIB = "PMID- 123\nTI  - A long\n      title\nFAU - Smith, J\nFAU - Lee, K\nDP  - 2020 May\nJT  - J Things\nPT  - Journal Article\n\nOWN - X\nTI  - Other\n"
ENL = "%0 Journal Article\n%T One\n%A Smith\n%A Lee\n%D 2001\n\n%0 Book\n%T Two\n"


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("bib", BIB, [("article", "Smith2020", {"author": 'Smith, John and M{\\"u}ller, Anna', "title": "A {Nested} title over lines", "year": "2020", "journal": "Journal of Things", "my.key": "x"}), ("misc", "web1", {"title": "Page"})]),
        ("ris", RIS, [("article", None, {"author": "Smith, J and Lee, K", "title": "One", "keywords": "a, b", "pages": "1--9"}), ("inproceedings", "7", {"title": "Two", "journal": "Meeting"})]),
        ("nbib", NBIB, [("article", "123", {"title": "A long title", "author": "Smith, J and Lee, K", "year": "2020", "journal": "J Things"}), ("misc", None, {"title": "Other"})]),
        ("enl", ENL, [("article", None, {"title": "One", "author": "Smith and Lee", "year": "2001"}), ("book", None, {"title": "Two"})]),
    ],
)
def test_readers(spark, kind, text, want):
    got = formats.load_text(spark, "﻿" + text, kind).orderBy("seq").collect()
    assert [(r.ENTRYTYPE, r.local_id, r.fields) for r in got] == want
    n = formats.count_records(spark.createDataFrame([("f", text)], "source string, content string"), kind).first()
    assert n.n == len(want)


def test_files_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("B", "book", "Two", None), ("A", "article", "One", "1999")], "ID string, ENTRYTYPE string, title string, year string")
    formats.write_text(r, formats.bib_text(["title", "year"]), str(tmp_path / "out"))
    got = formats.read_bib(formats.files(spark, str(tmp_path / "out"))).collect()
    assert sorted((x.local_id, x.ENTRYTYPE, x.fields.get("title"), x.fields.get("year")) for x in got) == [("A", "article", "One", "1999"), ("B", "book", "Two", None)]
    (tmp_path / "x.bib").write_text(BIB)
    assert formats.load(spark, str(tmp_path / "x.bib")).count() == 2
    with pytest.raises(NotImplementedError):
        formats.load(spark, "x.docx")
    (tmp_path / "t.csv").write_text('Title,Item DOI\n"a, ""b""",\nc,10.1/x\n')
    assert [tuple(x) for x in formats.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [('a, "b"', None), ("c", "10.1/x")]


def test_scalar_functions(spark):
    one = lambda col: spark.range(1).select(col).first()[0]
    assert one(T.unify_pages(F.lit("1123-45"))) == "1123--1145" and one(T.unify_pages(F.lit("1 – 5"))) == "1--5"
    assert one(T.slug(F.lit("The Émile/Test &amp; more – here!"))) == "the-emile-test-and-more-here"
    assert [one(T.roman_value(F.lit(x))) for x in ("xiv", "MCMXC", "abc")] == [14, 1990, None]
    assert one(T.normalise_doi(F.lit("https://doi.org/10.1/abC"))) == "10.1/ABC"
    assert [one(history.unique_suffix(F.lit(n))) for n in (1, 2, 27, 28, 53, 703, 704)] == ["", "a", "z", "aa", "az", "zz", "aaa"]


def test_as_of_rule(spark):
    facts = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("a", 30, 3), ("b", 1, 4), ("c", 1, 5)], "k string, at int, id int")
    rules = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("b", 7, "z")], "k string, start int, rule string")
    got = {r.id: r.rule for r in lookup.as_of_rule(facts, rules, "k", "at", "start").collect()}
    assert got == {1: "x", 2: "x", 3: "y", 4: "z", 5: None}


def test_upsert_order_and_time_variant(spark):
    stored = spark.createDataFrame([("a", 5, "x", 1), ("b", 5, "y", 2)], "k string, t int, v string, cited int")
    new = spark.createDataFrame([("a", 4, "late", 9), ("b", 6, "new", 9), ("b", 5, "old", 8), ("c", 1, "c", 3)], "k string, t int, v string, cited int")
    got = sorted(map(tuple, feed.upsert(stored, new, "k", "t", ["cited"], update_only=True).collect()))
    assert got == [("a", 5, "x", 1), ("b", 6, "new", 2), ("c", 1, "c", 3)]


def test_threshold_grid(spark):
    rows = [("r1", "p1", 3), ("r1", "p2", 1), ("r2", "p1", 2)]
    got = {(r.i, r.j): r.n for r in reports.threshold_grid(spark.createDataFrame(rows, "ref string, paper string, n_intext int")).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 2, (3, 1): 1}


def test_entry_works_without_the_optional_parts(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 15
    assert set(E.oracle_sql()) <= set(E.queries())


def test_global_id_pairs_of_a_large_block(spark):
    rows = [(f"R{i:04d}", f"10.1000/{i // 2}", "https://a.org/x/", None) for i in range(201)]
    r = spark.createDataFrame(rows, "ID string, doi string, url string, pubmedid string")
    names = ["author", "year", "title", "journal", "booktitle", "volume", "number", "ENTRYTYPE", "pages", "school", "publisher", "isbn"]
    r = r.select("*", *(F.lit(None).cast("string").alias(n) for n in names))
    got = {(p.a_ID, p.b_ID): p.kinds for p in dedupe.global_id_pairs(r).collect()}
    assert len(got) == 201 * 200 // 2
    assert got["R0002", "R0003"] == ["doi", "url"] and got["R0003", "R0004"] == ["url"]


def test_best_window_ratio_against_every_window():
    import random

    from recordloom.functions.similarity import best_window_ratio, indel_ratio

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        n = len(short)
        want = max((indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long))), default=0.0) if n else 100.0 * (not long)
        assert abs(best_window_ratio(a, b) - want) < 1e-9, (a, b)


def test_best_window_ratio_of_long_texts():
    from recordloom.functions.similarity import best_window_ratio

    assert best_window_ratio("needle in it", "x" * 20_000 + "needle in it" + "y" * 20_000) == 100.0


def test_load_and_save_by_suffix(spark, tmp_path):
    from recordloom.sources import formats

    (tmp_path / "a.csv").write_text("Record ID,Title,Year\n1,On things,2020\n2,,\n")
    (tmp_path / "a.json").write_text('[{"id": "7", "title": "On JSON", "entrytype": "article"}]', encoding="utf-8")
    got = formats.load(spark, str(tmp_path / "a.csv"), {"Record ID": "record_id"}, "record_id").collect()
    assert [(r.local_id, r.ENTRYTYPE, r.fields) for r in got] == [("1", "misc", {"title": "On things", "year": "2020"}), ("2", "misc", {})]
    got = formats.load(spark, str(tmp_path / "a.json"), id_column="id").collect()
    assert [(r.local_id, r.ENTRYTYPE, r.fields) for r in got] == [("7", "article", {"title": "On JSON"})]
    rows = spark.createDataFrame([("B", "article", "Smith, A", "T2", "2020"), ("A", "misc", None, "T1", None)], "ID string, ENTRYTYPE string, author string, title string, year string")
    formats.save(rows, str(tmp_path / "out.bib"))
    assert [(r.local_id, r.fields) for r in formats.read_bib(formats.files(spark, str(tmp_path / "out.bib"))).orderBy("local_id").collect()] == [("A", {"title": "T1"}), ("B", {"author": "Smith, A", "title": "T2", "year": "2020"})]
    for what in (lambda: formats.load(spark, "x.doc"), lambda: formats.save(rows, "x.doc")):
        with pytest.raises(NotImplementedError):
            what()

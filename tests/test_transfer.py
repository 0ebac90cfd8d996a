"""Operators that bring in metadata, edits and decisions, on small tables."""

from pyspark.sql import functions as F

from recordloom.operators import transfer as O


def test_enrichment_by_doi_then_title(spark):
    schema = "ID string, doi string, title string, volume string, year string"
    records = spark.createDataFrame([
        ("A", "10.1/a", "A study of large data systems", None, "UNKNOWN"),  # by DOI
        ("B", "10.1/b", "Something else entirely here", None, "1999"),  # wrong DOI, no other title
        ("C", None, "Review of the methods in small teams", "", None),  # by title
        ("D", "10.1/a", "Review of methods in small teams", "7", None),  # wrong DOI, then by title
        ("E", None, "ab", None, None), ("F", None, None, None, None), ("G", "10.1/none", "A study of large data systems", None, None),
    ], schema)
    meta = spark.createDataFrame([("10.1/a", "A Study of Large Data Systems", "3", "2001"), ("10.1/b", "Trust in networks", "4", "2002"), ("10.1/c", "Review of the Methods in Small Teams", "5", "2003"), (None, "A study", "9", "2009")], "doi string, title string, volume string, year string")
    got = {r.ID: (r.doi, r.volume, r.year, r.via) for r in O.enrich_records(records, meta, ["volume", "year"]).collect()}
    assert got == {
        "A": ("10.1/a", "3", "2001", "doi"), "B": (None, None, "1999", None), "C": ("10.1/c", "5", "2003", "title"), "D": ("10.1/c", "7", "2003", "title"), "E": (None, None, None, None), "F": (None, None, None, None),
        "G": ("10.1/none", None, None, None),
    }
    assert O.enrich_records(records.limit(0), meta, ["volume"]).collect() == [] and O.enrich_records(records, meta.limit(0), ["volume"]).count() == 7


def test_edited_worklist(spark):
    schema = "ID string, year string, volume string"
    records = spark.createDataFrame([("A", "1999", "1"), ("B", "2000", "2"), ("C", None, None), ("D", "2001", "4")], schema)
    edits = spark.createDataFrame([("A", "2005", "UNKNOWN"), ("B", "2000", None), ("C", None, "3")], schema)
    got = {r.ID: (r.year, r.volume, r.notes) for r in O.import_edits(records, edits, ["year", "volume"]).collect()}
    assert got == {"A": ("2005", "1", {}), "B": ("2000", None, {"volume": "IGNORE:missing"}), "C": (None, "3", {}), "D": ("2001", "4", {})}


def test_first_source(spark):
    schema = "ID string, ENTRYTYPE string, journal string, booktitle string, year string, volume string, number string, origins string, status string"
    row = lambda i, issue, source, status: (i, "article", "J", None, "2000", issue, "1", f"{source}/{i}", status)
    rows = [row("A", "1", "s.bib", "md_prepared"), row("B", "1", "s.bib", "md_imported"), row("C", "1", "t.bib", "md_processed"), row("D", "2", "s.bib", "md_processed"), row("E", "2", "s.bib", "md_prepared"), row("F", "3", "b.bib", "md_prepared"), row("G", "3", "a.bib", "md_prepared")]
    assert {r.ID for r in O.first_source(spark.createDataFrame(rows, schema)).collect()} == {"A", "G"}


def test_change_order_and_names(spark):
    df = spark.createDataFrame([(f"R{i:02d}", f"b/{i};a/{i}", i % 7) for i in range(40)], "ID string, origins string, s int").repartition(4)
    got = sorted((r.place, r.ID, r.origins) for r in O.change_order(df, F.col("s")).collect())
    want = sorted(range(40), key=lambda i: (-(i % 7), i))
    assert [g[1] for g in got] == [f"R{i:02d}" for i in want] and [g[0] for g in got] == list(range(1, 41)) and got[0][2] == "a/6;b/6"
    df = spark.createDataFrame([("1", "9"), (None, "8"), ("", "7")], "number string, issue string")
    assert [r.number for r in O.rename_where_absent(df, {"issue": "number", "absent": "x"}).collect()] == ["1", "8", "7"]

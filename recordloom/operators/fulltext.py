"""Full-text operators: checks of a record against its text, TEI documents, cover pages, reading statistics."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as T

c = F.col

# fixed values: phrases of publishers' cover pages
COVER_PHRASES = ["thisarticlewasdownloadedby", "seediscussions,stats,andauthorprofilesforthispublication", "pleasescrolldownforarticle", "youmaynotdistribute", "downloadedfrom"]


def squashed(col: Column) -> Column:
    """Lower-case letters and digits without accents."""
    return F.regexp_replace(F.lower(T.remove_accents(col)), "[^a-z0-9]+", "")


def no_text(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is worked out once for a row, however often ``of`` names it (inner functions would do so for each element)."""
    return F.transform(F.array(value), of)[0]


def _share(parts: Column, flat: Column) -> Column:
    """Share of the parts that have letters or digits which the squashed text holds."""
    words = F.filter(F.transform(parts, squashed), lambda w: w != "")
    return _once(words, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: flat.contains(w))) / F.size(ws)).otherwise(F.lit(0.0)))


def _title_share(title: Column, flat: Column) -> Column:
    # a text that holds the whole title holds its words, without a search for each
    whole = _once(squashed(title), lambda t: (t != "") & flat.contains(t))
    return F.when(whole, 1.0).otherwise(_share(F.split(title, " "), flat))


def title_share(title: Column, text: Column) -> Column:
    """Share of the title's words that the text has."""
    return _once(squashed(text), lambda flat: _title_share(title, flat))


def author_share(author: Column, text: Column) -> Column:
    """Share of the last names that the text has."""
    return _once(squashed(text), lambda flat: _share(T.last_names(author), flat))


def text_defects(records: DataFrame, text: str = "text") -> DataFrame:
    """ID, defect of the full text: no text, title or authors not in it. The text is squashed once, whatever the number of words."""
    empty = no_text(c(text))

    def found(flat: Column) -> Column:
        title = c("title").isNotNull() & (_title_share(c("title"), flat) <= 0.9)
        author = c("author").isNotNull() & ~F.lower("title").contains("editorial") & (_share(T.last_names(c("author")), flat) <= 0.8)
        return F.array_compact(F.array(F.when(empty, F.lit("no-text-in-pdf")), F.when(~empty & title, F.lit("title-not-in-pdf")), F.when(~empty & author, F.lit("author-not-in-pdf"))))

    return records.select("ID", F.explode_outer(_once(squashed(c(text)), found)).alias("defect")).filter("defect is not null")


def has_cover_page(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"\s", "")
    return reduce(lambda a, b: a | b, (flat.contains(p) for p in COVER_PHRASES))


def reading_statistics(citations: DataFrame) -> DataFrame:
    """citations (doc, ID) -> ID, n_docs that cite it, intensity: all mentions."""
    return citations.groupBy("doc", "ID").agg(F.count("*").alias("n")).groupBy("ID").agg(F.count("*").alias("n_docs"), F.sum("n").alias("intensity"))


def citation_network(references: DataFrame) -> DataFrame:
    """references (paper, key, title, n_intext, in_sample) -> one row for each key, most cited first."""
    return references.groupBy("key").agg(
        F.min("title").alias("title"), F.count_distinct("paper").alias("n_papers"), F.sum("n_intext").alias("n_intext"), F.bool_or("in_sample").alias("in_sample")
    ).orderBy(F.desc("n_papers"), "key")


_NS = re.compile(r"\{[^}]*\}")
TEI = "id string, title string, abstract string, keywords array<string>, authors array<string>, paragraphs array<string>, references array<struct<id:string,title:string,year:string>>, error string"


def parse_tei(xml: str | None) -> dict:
    """Title, abstract, keywords, authors ("Surname, Forename"), paragraphs of 40 characters or more, references."""
    empty = {"title": None, "abstract": None, "keywords": [], "authors": [], "paragraphs": [], "references": [], "error": None}
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError as e:
        return empty | {"error": str(e)}
    for el in root.iter():
        el.tag = _NS.sub("", el.tag) if isinstance(el.tag, str) else ""
    flat = lambda el: " ".join("".join(el.itertext()).split()) if el is not None else None
    header = root.find(".//teiHeader")
    header = root if header is None else header

    def person(a: ET.Element) -> str | None:
        name = a.find(".//persName")
        last = flat(name.find("surname")) if name is not None else None
        first = [x + "." if len(x) == 1 else x for x in (flat(f) for f in (name.findall("forename") if name is not None else [])) if x]
        return f"{last}, {' '.join(first)}" if last and first else last

    refs = []
    for b in root.iterfind(".//listBibl/biblStruct"):
        date = b.find(".//date")
        refs.append({"id": b.get("{http://www.w3.org/XML/1998/namespace}id"), "title": flat(b.find(".//title")), "year": (date.get("when") or "")[:4] or None if date is not None else None})
    body = root.find(".//text/body")
    return {
        "title": flat(header.find(".//titleStmt/title")) or None, "abstract": flat(header.find(".//abstract")) or None, "keywords": [x for x in (flat(t) for t in header.iterfind(".//keywords/term")) if x],
        "authors": [x for x in (person(a) for a in header.iterfind(".//sourceDesc//author")) if x], "paragraphs": [x for x in (flat(p) for p in (body.iterfind(".//p") if body is not None else [])) if x and len(x) >= 40],
        "references": refs, "error": None,
    }


def tei_documents(docs: DataFrame) -> DataFrame:
    """docs (id, xml) -> the parts of each TEI document; what can't be parsed has an error and no parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [parse_tei(x) for x in df["xml"]]
            yield pd.DataFrame({"id": df["id"], **{k: [r[k] for r in rows] for k in ("title", "abstract", "keywords", "authors", "paragraphs", "references", "error")}})

    return docs.select("id", "xml").mapInPandas(run, TEI)


def incomplete_files(records: DataFrame, found: str) -> DataFrame:
    """ID, expected, found: files whose number of pages (column ``found``) isn't that of the record's pages, in Arabic or Roman numbers."""
    expected = T.expected_pages(T.unify_pages(F.col("pages")))
    return records.filter("pages is not null").withColumn("expected", expected).filter(F.col("expected") != F.col(found)).select("ID", "expected", F.col(found).alias("found"))

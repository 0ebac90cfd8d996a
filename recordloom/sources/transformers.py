"""Items of metadata services (JSON text) as records: nested fields by from_json, no network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as T

c = F.col
DATE = "struct<`date-parts`:array<array<int>>>"
WORK = (
    "struct<DOI:string,type:string,title:array<string>,`container-title`:array<string>,volume:string,issue:string,`journal-issue`:struct<issue:string>,page:string,abstract:string,language:string,`is-referenced-by-count`:string,"
    f"author:array<struct<given:string,family:string,name:string>>,`published-print`:{DATE},published:{DATE},`published-online`:{DATE},`update-to`:array<struct<type:string>>>"
)
OPEN = (
    "struct<id:string,doi:string,display_name:string,title:string,type:string,type_crossref:string,language:string,publication_year:string,is_retracted:boolean,cited_by_count:string,"
    "biblio:struct<volume:string,issue:string,first_page:string,last_page:string>,primary_location:struct<source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>>"
)
PREPRINT = "struct<id:string,title:string,summary:string,published:string,`arxiv_doi`:string,authors:array<struct<name:string>>,links:array<struct<href:string,type:string>>>"


def _year(d: str) -> Column:
    return F.get(F.get(c(f"w.{d}.`date-parts`"), F.lit(0)), F.lit(0)).cast("string")


def _plain(col: Column) -> Column:
    """Without tags and the common entities, white space as one space."""
    v = F.regexp_replace(col, "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def works(items: DataFrame) -> DataFrame:
    """items (item: JSON of a registered work) -> record columns. Print dates come before published and online ones; a work that isn't published has the year forthcoming."""
    w = items.select(F.from_json("item", WORK).alias("w"))
    journal = c("w.type") == "journal-article"
    kind = F.when(journal, "article").when(c("w.type") == "proceedings-article", "inproceedings").when(c("w.type").isin("book", "monograph"), "book").when(c("w.type") == "book-chapter", "inbook").otherwise("misc")
    container = _plain(F.get(c("w.`container-title`"), F.lit(0)))
    number = F.coalesce("w.issue", "w.journal-issue.issue")
    year = F.coalesce(_year("`published-print`"), _year("published"), _year("`published-online`"))
    names = F.transform(c("w.author"), lambda a: F.coalesce(F.when(a["given"].isNotNull(), F.concat_ws(", ", a["family"], a["given"])), a["family"], a["name"]))
    title = _plain(F.get(c("w.title"), F.lit(0)))
    gone = F.coalesce(F.exists(c("w.`update-to`"), lambda u: u["type"] == "retraction"), F.lit(False)) | F.coalesce(F.lower(title).contains("(retracted)"), F.lit(False))
    open_ended = journal & c("w.volume").isNull() & number.isNull()
    return w.select(
        F.upper("w.DOI").alias("doi"), kind.alias("ENTRYTYPE"), title.alias("title"), F.array_join(names, " and ").alias("author"), F.when(year.isNull() | open_ended, "forthcoming").otherwise(year).alias("year"),
        F.when(journal, container).alias("journal"), F.when(~journal, container).alias("booktitle"), c("w.volume").alias("volume"), number.alias("number"), T.unify_pages(c("w.page")).alias("pages"),
        _plain(c("w.abstract")).alias("abstract"), c("w.language").alias("language"), c("w.`is-referenced-by-count`").alias("cited_by"), gone.alias("retracted"),
    )


def open_works(items: DataFrame) -> DataFrame:
    """items (item: JSON of an open catalogue's work) -> record columns."""
    w = items.select(F.from_json("item", OPEN).alias("w"))
    kind = F.when(c("w.type_crossref") == "proceedings-article", "inproceedings").when((c("w.type_crossref") == "journal-article") | (c("w.type") == "article"), "article").otherwise("misc")
    source = c("w.primary_location.source.display_name")
    name = lambda n: F.when(n.contains(" "), F.concat(F.element_at(F.split(n, " "), -1), F.lit(", "), F.array_join(F.slice(F.split(n, " "), F.lit(1), F.size(F.split(n, " ")) - 1), " "))).otherwise(n)
    return w.withColumn("k", kind).select(
        F.element_at(F.split("w.id", "/"), -1).alias("local_id"), T.normalise_doi(c("w.doi")).alias("doi"), c("k").alias("ENTRYTYPE"), F.coalesce("w.display_name", "w.title").alias("title"),
        F.array_join(F.transform(c("w.authorships"), lambda a: name(a["author"]["display_name"])), " and ").alias("author"), c("w.publication_year").alias("year"),
        F.when(c("k") == "article", source).alias("journal"), F.when(c("k") == "inproceedings", source).alias("booktitle"), c("w.biblio.volume").alias("volume"), c("w.biblio.issue").alias("number"),
        F.concat_ws("--", "w.biblio.first_page", "w.biblio.last_page").alias("pages"), c("w.language").alias("language"), c("w.cited_by_count").alias("cited_by"), F.coalesce("w.is_retracted", F.lit(False)).alias("retracted"),
    )


def preprints(items: DataFrame) -> DataFrame:
    """items (item: JSON of a preprint entry) -> record columns; links to PDFs are the full text."""
    w = items.select(F.from_json("item", PREPRINT).alias("w"))
    link = lambda ok: F.get(F.filter(c("w.links"), ok), F.lit(0))["href"]
    return w.select(
        F.element_at(F.split("w.id", "/"), -1).alias("local_id"), F.lit("techreport").alias("ENTRYTYPE"), F.trim(F.regexp_replace("w.title", r"\s+", " ")).alias("title"), F.array_join(F.transform("w.authors", lambda a: a["name"]), " and ").alias("author"),
        F.substring("w.published", 1, 4).alias("year"), F.upper("w.arxiv_doi").alias("doi"), link(lambda x: x["type"] == "application/pdf").alias("fulltext"), link(lambda x: F.coalesce(x["type"], F.lit("")) != "application/pdf").alias("url"), _plain(c("w.summary")).alias("abstract"),
    )

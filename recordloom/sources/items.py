"""Items of further catalogues (JSON or XML text) as records; parsed by Spark's readers of text columns, which leave a broken item empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as T

c = F.col
# fixed values: kinds of publications and the entry types they become
PAPER_TYPES = {
    "Review": "article", "JournalArticle": "article", "CaseReport": "techreport", "ClinicalTrial": "misc", "Dataset": "misc", "Editorial": "misc", "LettersAndComments": "misc",
    "MetaAnalysis": "article", "News": "misc", "Study": "misc", "Book": "book", "BookSection": "inbook", "Conference": "inproceedings",
}
ABSTRACT_TYPES = {"cp": "inproceedings", "ar": "article", "re": "article", "ip": "article", "ed": "article", "le": "article", "no": "article", "dp": "article", "ch": "incollection", "bk": "book"}
BIBLIOGRAPHY_TYPES = {"Journal Articles": "article", "Conference and Workshop Papers": "inproceedings", "Books and Theses": "book", "Informal and Other Publications": "misc"}
PARTICLES = ["de", "del", "la", "van", "von", "der", "di", "da", "le"]

PAPER = (
    "struct<paperId:string,title:string,year:string,venue:string,abstract:string,citationCount:string,publicationTypes:array<string>,authors:array<struct<name:string>>,"
    "externalIds:struct<DOI:string,DBLP:string>,journal:struct<name:string,volume:string,pages:string>>"
)
ENTRY = (
    "struct<`dc:identifier`:string,`dc:title`:string,`dc:creator`:string,`prism:publicationName`:string,`prism:volume`:string,`prism:issueIdentifier`:string,`prism:pageRange`:string,"
    "`prism:coverDate`:string,`prism:doi`:string,subtype:string,`prism:aggregationType`:string,`prism:issn`:string,`prism:eIssn`:string,`prism:isbn`:string,`citedby-count`:string>"
)
DOC = "struct<id:string,title_display:string,author_display:array<string>,journal:string,volume:string,issue:string,publication_date:string,abstract:array<string>>"
INFO = "struct<title:string,authors:struct<author:array<struct<text:string>>>,venue:string,year:string,type:string,key:string,doi:string,ee:string,volume:string,number:string>"
CITATION = (
    "MedlineCitation struct<Article:struct<ArticleTitle:string,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,Abstract:struct<AbstractText:string>,"
    "Journal:struct<ISOAbbreviation:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string>>>>>,PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


def _lookup(table: dict[str, str], col: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[col]


def last_name_first(name: Column) -> Column:
    """A name as "Last, First"; a name of one word stays."""
    words = F.split(F.trim(name), " +")
    return F.when(F.size(words) > 1, F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))).otherwise(name)


def particle_last_name(name: Column) -> Column:
    """As last_name_first, with a particle ahead of the last name kept with it, in braces."""
    words = F.split(F.trim(name), " +")
    n = F.size(words)
    held = F.concat(F.lit("{"), F.array_join(F.slice(words, -2, 2), " "), F.lit("}, "), F.array_join(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), " "))
    return F.when((n > 2) & F.lower(F.get(words, n - 2)).isin(PARTICLES), held).otherwise(last_name_first(name))


def ordered_pages(pages: Column) -> Column:
    """A range of numbers with two hyphens, smaller page first; one page where both are equal; anything else without white space and letters."""
    clean = F.regexp_replace(pages, r"\s+|[a-zA-Z]+", "")
    a, b = (F.regexp_extract(clean, "^([0-9]+)-([0-9]+)", i).try_cast("long") for i in (1, 2))
    both = F.when(a == b, a.cast("string")).otherwise(F.concat_ws("--", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))
    return F.when(~pages.contains("-"), pages).when(a.isNotNull() & b.isNotNull(), both).otherwise(clean)


def papers(items: DataFrame) -> DataFrame:
    """items (item: JSON of a graph's paper) -> record columns. The first publication type decides; what is misc in a journal is an article."""
    w = items.select(F.from_json("item", PAPER).alias("w"))
    kind = F.coalesce(_lookup(PAPER_TYPES, F.get(c("w.publicationTypes"), F.lit(0))), F.lit("misc"))
    kind = F.when((kind == "misc") & c("w.journal").isNotNull(), "article").otherwise(kind)
    names = F.transform(c("w.authors"), lambda a: last_name_first(a["name"]))
    return w.withColumn("k", kind).select(
        c("w.paperId").alias("local_id"), c("k").alias("ENTRYTYPE"), c("w.title").alias("title"), F.array_join(names, " and ").alias("author"), c("w.year").alias("year"),
        F.when(c("k") == "article", c("w.venue")).alias("journal"), F.when(c("k").isin("inproceedings", "inbook"), F.coalesce("w.journal.name", "w.venue")).alias("booktitle"),
        F.when(c("k") == "article", c("w.journal.volume")).alias("volume"), F.when(c("k") == "article", ordered_pages(c("w.journal.pages"))).alias("pages"),
        F.upper("w.externalIds.DOI").alias("doi"), c("w.externalIds.DBLP").alias("dblp_key"), c("w.citationCount").alias("cited_by"), F.trim(F.replace("w.abstract", F.lit("\n"), F.lit(" "))).alias("abstract"),
    )


def abstracts(items: DataFrame) -> DataFrame:
    """items (item: JSON of an abstract database's entry) -> record columns. The subtype decides the entry's type, else the kind of container and its numbers."""
    w = items.select(F.from_json("item", ENTRY).alias("w"))
    kind, issn, isbn = c("w.`prism:aggregationType`"), F.coalesce("w.`prism:issn`", "w.`prism:eIssn`").isNotNull(), c("w.`prism:isbn`").isNotNull()
    other = F.when((kind == "Journal") | issn & ~isbn, "article").when(kind.isin("Conference Proceeding", "Book Series") | isbn, "inproceedings").when(kind == "Book", "book").otherwise("misc")
    return w.withColumn("k", F.coalesce(_lookup(ABSTRACT_TYPES, F.lower(F.trim("w.subtype"))), other)).select(
        F.split_part(c("w.`dc:identifier`"), F.lit(":"), F.lit(2)).alias("local_id"), c("k").alias("ENTRYTYPE"), c("w.`dc:title`").alias("title"), F.replace("w.`dc:creator`", F.lit(";"), F.lit(" and ")).alias("author"),
        F.substring("w.`prism:coverDate`", 1, 4).alias("year"), F.when(c("k") == "article", c("w.`prism:publicationName`")).alias("journal"), F.when(c("k").isin("inproceedings", "incollection"), c("w.`prism:publicationName`")).alias("booktitle"),
        c("w.`prism:volume`").alias("volume"), c("w.`prism:issueIdentifier`").alias("number"), T.unify_pages(c("w.`prism:pageRange`")).alias("pages"), F.upper("w.`prism:doi`").alias("doi"),
        F.regexp_replace("w.`prism:isbn`", r"[\[\] ]", "").alias("isbn"), c("w.`citedby-count`").alias("cited_by"),
    )


def articles(items: DataFrame) -> DataFrame:
    """items (item: JSON of an open journal's document) -> record columns; a title that says so marks a retraction."""
    w = items.select(F.from_json("item", DOC).alias("w"))
    return w.select(
        F.upper("w.id").alias("doi"), F.lit("article").alias("ENTRYTYPE"), c("w.title_display").alias("title"), F.array_join(F.transform("w.author_display", particle_last_name), " and ").alias("author"),
        F.split_part(c("w.publication_date"), F.lit("-"), F.lit(1)).alias("year"), c("w.journal").alias("journal"), c("w.volume").alias("volume"), c("w.issue").alias("number"),
        F.get(c("w.abstract"), F.lit(0)).alias("abstract"), F.lower("w.title_display").contains("(retracted)").alias("retracted"),
    )


def bibliography_entries(items: DataFrame) -> DataFrame:
    """items (item: JSON of a bibliography's entry) -> record columns. Titles lose their final point; braces go."""
    w = items.select(F.from_json("item", INFO).alias("w"))
    bare = lambda v: F.translate(v, "{}", "")
    title = F.regexp_replace(F.regexp_replace("w.title", r"\.+$", ""), r"\s+", " ")
    url = F.when(~c("w.ee").contains("https://doi.org") & ~c("w.ee").contains("https://dblp.org"), c("w.ee"))
    return w.withColumn("k", F.coalesce(_lookup(BIBLIOGRAPHY_TYPES, c("w.type")), F.lit("misc"))).select(
        F.concat(F.lit("https://dblp.org/rec/"), "w.key").alias("dblp_key"), c("k").alias("ENTRYTYPE"), bare(F.trim(title)).alias("title"), bare(F.array_join(F.transform("w.authors.author", lambda a: last_name_first(a["text"])), " and ")).alias("author"),
        c("w.year").alias("year"), F.when(c("k") == "article", bare(c("w.venue"))).alias("journal"), F.when(c("k") == "inproceedings", bare(c("w.venue"))).alias("booktitle"), c("w.volume").alias("volume"), c("w.number").alias("number"), F.upper("w.doi").alias("doi"), url.alias("url"),
    )


def citations(items: DataFrame) -> DataFrame:
    """items (item: XML of a medical citation) -> record columns. Titles lose brackets and the final point; an entry without a journal is misc."""
    w = items.select(F.from_xml("item", CITATION).alias("w"))
    a = "w.MedlineCitation.Article"
    title = F.regexp_replace(F.trim(f"{a}.ArticleTitle"), r"\.+$", "")
    title = F.when(title.startswith("[") & title.endswith("]"), F.substring(title, F.lit(2), F.char_length(title) - 2)).otherwise(title)
    number = lambda kind: F.get(F.filter(c("w.PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == kind), F.lit(0))["_VALUE"]
    return w.select(
        F.upper(number("pubmed")).alias("pubmedid"), F.upper(number("doi")).alias("doi"), F.when(c(f"{a}.Journal.ISOAbbreviation").isNotNull(), "article").otherwise("misc").alias("ENTRYTYPE"), title.alias("title"),
        F.array_join(F.transform(f"{a}.AuthorList.Author", lambda x: F.concat_ws(", ", x["LastName"], x["ForeName"])), " and ").alias("author"), c(f"{a}.Journal.JournalIssue.PubDate.Year").alias("year"),
        c(f"{a}.Journal.ISOAbbreviation").alias("journal"), c(f"{a}.Journal.JournalIssue.Volume").alias("volume"), c(f"{a}.Journal.JournalIssue.Issue").alias("number"), c(f"{a}.Abstract.AbstractText").alias("abstract"),
    )

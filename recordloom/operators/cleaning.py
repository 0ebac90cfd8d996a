"""Cleaning of records of unknown sources, language filter, metadata checks, samples, resumed work and backward search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions.similarity import partial_ratio_udf
from recordloom.operators.prep import comma_names
from recordloom.operators.language import Profiles, tell_languages

c = F.col
#: fields whose white space and markup are cleaned
TEXT_FIELDS = ["title", "author", "journal", "booktitle"]


def _known(f: str) -> Column:
    return c(f).isNotNull() & ~c(f).isin("", "UNKNOWN")


def clean_characters(records: DataFrame) -> DataFrame:
    """White space of the text fields as single spaces, without tags; character references stay."""
    return records.withColumns({f: F.regexp_replace(F.regexp_replace(f, r"\s+", " "), "<[^>]*>", "") for f in TEXT_FIELDS})


def impute_year(records: DataFrame, date: str = "date") -> DataFrame:
    """A missing year from the first four digits of the date."""
    return records.withColumn("year", F.coalesce("year", F.nullif(F.regexp_extract(date, "[0-9]{4}", 0), F.lit(""))))


def format_fields(records: DataFrame) -> DataFrame:
    """Authors as "Last, First" without what is in parentheses, titles in capitals as sentences, pages with two hyphens, a language as its code of three letters or none."""
    odd = (F.char_length(F.split_part("author", F.lit(" "), F.lit(1))) == 1) | ~c("author").contains(", ")
    author = F.rtrim(F.replace(F.regexp_replace(F.when(odd, comma_names(c("author"))).otherwise(c("author")), r"\([^)]*\)", ""), F.lit("  "), F.lit(" ")))
    return records.withColumns({
        "author": F.when(_known("author"), author).otherwise(c("author")), "title": F.when(_known("title"), T.polish_mostly_upper(c("title"))).otherwise(c("title")),
        "pages": T.unify_pages(c("pages")), "language": F.when(c("language").rlike("^[a-z]{3}$"), c("language")),
    })


def drop_redundant_containers(records: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Of a journal and a booktitle that say the same, an article keeps the journal and a conference paper the booktitle."""
    both = c("journal").isNotNull() & c("booktitle").isNotNull() & c("ENTRYTYPE").isin("article", "inproceedings")
    # the comparison is only made where both stand
    same = F.coalesce(partial_ratio_udf(F.when(both, F.lower("journal")), F.when(both, F.lower("booktitle"))) > threshold, F.lit(False))
    marked = records.withColumn("_same", same)
    return marked.withColumns({"booktitle": F.when(~(c("_same") & (c("ENTRYTYPE") == "article")), c("booktitle")), "journal": F.when(~(c("_same") & (c("ENTRYTYPE") == "inproceedings")), c("journal"))}).drop("_same")


def language_filter(records: DataFrame, profiles: Profiles, keep: list[str] | None = None, short: int = 30) -> DataFrame:
    """ID, title, other_title (language=title of the one in brackets), language, verdict: kept, manual or excluded.

    Without a title the language is dropped and the record kept; a language to keep is kept; short titles count as English; titles in several
    languages, the further one in brackets, are split; else the title's trigrams tell, and one whose language they don't tell needs a hand.
    """
    keep = keep or ["eng"]
    split = c("title").rlike(r"^.+\[.+\]\s*$")
    first = F.when(split, F.trim(F.regexp_extract("title", r"^(.+?)\s*\[(.+)\]\s*$", 1))).otherwise(c("title"))
    second = F.when(split, F.regexp_extract("title", r"^(.+?)\s*\[(.+)\]\s*$", 2))
    r = records.select("ID", "title", "language", first.alias("first"), second.alias("second"))
    texts = r.select("ID", F.explode(F.array(F.struct(F.lit(1).alias("place"), c("first").alias("text")), F.struct(F.lit(2).alias("place"), c("second").alias("text")))).alias("t")).select("ID", "t.*").filter("text is not null")
    told = tell_languages(texts, profiles, ["ID", "place"]).groupBy("ID").agg(*(F.max(F.when(c("place") == i, c("lang"))).alias(f"told_{i}") for i in (1, 2)))
    language = F.when(~_known("title"), F.lit(None).cast("string")).when(c("language").isin(keep), c("language")).when(F.char_length("title") < short, "eng").otherwise(c("told_1"))
    out = r.join(told, "ID", "left").withColumns({"_language": language, "_other": F.when(c("second").isNotNull(), F.concat_ws("=", F.coalesce("told_2", F.lit("und")), "second"))})
    verdict = F.when(~_known("title") | c("_language").isin(keep), "kept").when(c("_language").isNull(), "manual").otherwise("excluded")
    return out.withColumn("verdict", verdict).select("ID", c("first").alias("title"), c("_other").alias("other_title"), c("_language").alias("language"), "verdict")


def doi_metadata_defects(records: DataFrame, metadata: DataFrame, fields: list[str] | None = None, least: float = 60.0) -> DataFrame:
    """ID, field: fields of at least five characters that hardly resemble those of the same DOI's metadata."""
    fields = fields or ["author", "title", "journal"]
    m = metadata.select(T.normalise_doi(c("doi")).alias("_doi"), *(c(f).alias(f"m_{f}") for f in fields))
    joined = records.withColumn("_doi", T.normalise_doi(c("doi"))).join(m, "_doi")
    rows = joined.select("ID", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("a"), F.lower(f"m_{f}").alias("b")) for f in fields))).alias("x")).select("ID", "x.*")
    rows = rows.filter((F.char_length("a") >= 5) & (F.char_length("b") >= 5))
    return rows.withColumn("ratio", partial_ratio_udf("a", "b")).filter(c("ratio") < least).select("ID", "field")


def random_sample(records: DataFrame, n: int, seed: str = "1") -> DataFrame:
    """n records in an order that the seed and the ID alone decide; the same again for the same seed."""
    return records.orderBy(F.md5(F.concat(c("ID"), F.lit(f"/{seed}")).cast("binary")), "ID").limit(n)


def resume(records: DataFrame, done: DataFrame, work) -> DataFrame:
    """The results of an interrupted operation completed: rows of ``done`` (with an ID) stay, ``work`` is applied to the records that it lacks."""
    return done.unionByName(work(records.join(done.select("ID"), "ID", "left_anti")), allowMissingColumns=True)


def backward_candidates(references: DataFrame, known: DataFrame, min_intext: int = 1, min_citing: int = 1) -> DataFrame:
    """references (paper, key, n_intext), known (key) -> key, n_citing: works that at least ``min_citing`` papers cite ``min_intext`` times or more, without those known."""
    strong = references.groupBy("paper", "key").agg(F.sum("n_intext").alias("n")).filter(c("n") >= min_intext)
    return strong.groupBy("key").agg(F.count("*").alias("n_citing")).filter(c("n_citing") >= min_citing).join(known.select("key").distinct(), "key", "left_anti")

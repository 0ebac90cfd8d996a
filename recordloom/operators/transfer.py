"""What comes into a record set from elsewhere, or goes out of it: metadata, decisions, languages, edited worklists, other projects, bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions.similarity import ratio_bound, ratio_udf
from recordloom.operators.history import next_ids
from recordloom.operators.prep import enrich
from recordloom.operators.similar import similar_between, word_tokens
from recordloom.schema import POST
from recordloom.session import materialize
from recordloom.sources import formats

c = F.col


def _blank(f: str) -> Column:
    return c(f).isNull() | c(f).isin("", "UNKNOWN")


def enrich_records(records: DataFrame, metadata: DataFrame, fields: list[str], least: float = 0.8, alike: float = 0.7, short: int = 5) -> DataFrame:
    """records (ID, title, doi, fields, ...) with fields filled in from metadata (doi, title, fields), and ``via``: doi, title or null.

    A DOI whose metadata has a title less alike than ``least`` is dropped. Records that have no DOI then, and a title of at least ``short`` characters, ask by title: of metadata whose titles' words have
    a Jaccard coefficient of ``alike`` or more the one of the most similar title counts, the smaller DOI of equals, if it is as alike as ``least``. Fields that are known stay.
    """
    one = materialize(metadata.filter("doi is not null").groupBy("doi").agg(F.min(F.struct("title", *fields)).alias("m")).select("doi", "m.*"), "metadata")
    first = materialize(enrich(records, one, "doi", fields, least), "enriched")
    first = first.withColumn("_a", F.when(~c("linked") & c("doi").isNull() & (F.char_length("title") >= short) & (c("title") != "UNKNOWN"), F.lower("title")))
    # of one title only the smallest DOI can count, and records of one title have one answer: copies meet as one
    asks = first.filter("_a is not null").groupBy("_a").agg(F.min("ID").alias("_id"))
    offers = one.filter("title is not null").groupBy(F.lower("title").alias("_b")).agg(F.min_by(F.struct(c("doi").alias("_doi"), *(c(f).alias(f"_m_{f}") for f in fields)), "doi").alias("_m"))
    words = lambda df, key, title: df.select(c(key).alias("ID"), word_tokens(c(title)).alias("tokens"))
    near = similar_between(words(asks, "_id", "_a"), words(offers, "_m._doi", "_b"), alike).select(c("a_ID").alias("_id"), c("b_ID").alias("_doi"))
    found = near.join(asks, "_id").join(offers.select(c("_m._doi").alias("_doi"), "_b", "_m"), "_doi").select("_a", "_b", "_m")
    found = found.filter(ratio_bound(c("_a"), c("_b")) >= 100 * least).withColumn("_r", ratio_udf("_a", "_b")).filter(c("_r") >= 100 * least)
    best = found.groupBy("_a").agg(F.min_by("_m", F.struct(-c("_r"), c("_m._doi"))).alias("_best"))
    out = first.join(best, "_a", "left")
    filled = {f: F.when(c("_best").isNotNull() & _blank(f), F.coalesce(c(f"_best._m_{f}"), c(f))).otherwise(c(f)) for f in fields}
    via = F.when(c("linked"), "doi").when(c("_best").isNotNull(), "title")
    return out.withColumns(filled | {"doi": F.coalesce("doi", "_best._doi"), "via": via}).drop("_a", "_best", "linked")


def first_source(records: DataFrame, ready: str = "md_prepared") -> DataFrame:
    """ID, toc, source, status: records of each issue's best source become md_processed, where the issue has no processed record of that source.

    The best source of an issue is that of most of its records (by their first origin), the first in the alphabet of equals.
    """
    r = records.withColumns({"toc": T.toc_key(), "source": T.origin_prefix(F.split("origins", ";")[0])}).filter("toc is not null")
    counts = r.groupBy("toc", "source").agg(F.count("*").alias("n"), F.bool_or(c("status").isin(POST["md_processed"])).alias("done"))
    best = counts.groupBy("toc").agg(F.min_by(F.struct("source", "done"), F.struct(-c("n"), c("source"))).alias("b")).filter("not b.done").select("toc", "b.source")
    return r.filter(c("status") == ready).join(best, ["toc", "source"]).select("ID", "toc", "source", F.lit("md_processed").alias("status"))


def distribute(target: DataFrame, records: DataFrame, width: int = 6) -> DataFrame:
    """target (origin, id), records (ID) -> target with the records appended under the next ids, in the order of the ID; those that it has keep theirs."""
    return next_ids(target, records.select(c("ID").alias("origin")), "origin", width)


def import_edits(records: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """records (ID, fields) with a worklist edited by hand (ID, fields): changed fields that aren't UNKNOWN are taken, cleared ones become null and are noted in ``notes`` (field -> IGNORE:missing)."""
    e = edits.select("ID", F.lit(True).alias("_e"), *(c(f).alias(f"_n_{f}") for f in fields))
    j = records.join(e, "ID", "left")
    edited = c("_e").isNotNull()
    new = {f: F.when(edited & c(f"_n_{f}").isNull(), F.lit(None)).when(edited & (c(f"_n_{f}") != "UNKNOWN"), c(f"_n_{f}")).otherwise(c(f)) for f in fields}
    cleared = F.array_compact(F.array(*(F.when(edited & c(f).isNotNull() & c(f"_n_{f}").isNull(), F.struct(F.lit(f), F.lit("IGNORE:missing"))) for f in fields)))
    return j.withColumn("notes", F.map_from_entries(cleared)).withColumns(new).drop("_e", *(f"_n_{f}" for f in fields))


def import_statuses(records: DataFrame, other: DataFrame, key: Column) -> DataFrame:
    """ID, decision: the prescreen's outcome in another project (its records have status and seq), of the earliest of its records with the same key; null where it had none yet."""
    theirs = other.select(key.alias("_k"), "status", "seq").filter("_k is not null").groupBy("_k").agg(F.min_by("status", "seq").alias("other"))
    included = c("other").isin(POST["rev_prescreen_included"]) & (c("other") != "rev_prescreen_excluded")
    decision = F.when(included, "rev_prescreen_included").when(c("other") == "rev_prescreen_excluded", "rev_prescreen_excluded")
    return records.select("ID", key.alias("_k")).join(theirs, "_k").select("ID", decision.alias("decision"))


def import_languages(records: DataFrame, languages: DataFrame, excluded: str = "rev_prescreen_excluded", reset: str = "md_prepared") -> DataFrame:
    """ID, language, status: languages set by hand (ID, language); records that were excluded for lack of one are reset."""
    new = languages.select("ID", c("language").alias("_new")).dropDuplicates(["ID"])
    j = records.join(new, "ID", "left")
    return j.select("ID", F.coalesce("_new", "language").alias("language"), F.when(c("_new").isNotNull() & (c("status") == excluded), reset).otherwise(c("status")).alias("status"))


def curate_provenance(provenance: Column, curated: Column, source: str) -> Column:
    """The provenance map of a record: one entry, the curation, where the condition holds."""
    entry = F.create_map(F.lit("CURATED"), F.struct(F.lit(source).alias("source"), F.lit("").alias("note")))
    return F.when(curated, entry).otherwise(provenance)


def bibliography(records: DataFrame, kind: str = "bib", fields: list[str] | None = None, states: tuple[str, ...] = ("rev_included", "rev_synthesized")) -> DataFrame:
    """ID, text: records of the given states as entries of a bibliography (bib, ris or md)."""
    texts = {"bib": lambda: formats.bib_text(fields), "ris": formats.ris_text, "md": lambda: formats.markdown_row(fields or ["author", "title", "year"])}
    if kind not in texts:
        raise NotImplementedError(f"no bibliography as {kind}")
    return records.filter(c("status").isin(*states)).select("ID", texts[kind]().alias("text"))


def change_order(records: DataFrame, score: Column) -> DataFrame:
    """ID, origins (in order), score, place: records by their score, the largest first. Places are counted by ranges of scores, so no task numbers all records."""
    scored = records.select("ID", F.array_join(F.array_sort(F.split("origins", ";")), ";").alias("origins"), score.alias("score"))
    parts = materialize(scored.repartitionByRange(F.desc("score"), "ID").withColumn("_p", F.spark_partition_id()), "ordered")
    before = parts.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    n = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("score"), "ID"))
    return parts.join(before.select("_p", "_before"), "_p").select("ID", "origins", "score", (c("_before") + n).alias("place"))


def rename_where_absent(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fields under another name (old -> new): the new one takes the old one's value where it has none, and the old one goes."""
    have = [old for old in names if old in records.columns]
    filled = {names[old]: F.coalesce(F.nullif(c(names[old]), F.lit("")), c(old)) if names[old] in records.columns else c(old) for old in have}
    return records.withColumns(filled).drop(*have)

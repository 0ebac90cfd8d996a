"""Which database a search file comes from: scored predicates over the file's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def _times(needle: str) -> Column:
    return F.regexp_count(c("content"), F.lit(needle))


def confidences() -> dict[str, Column]:
    """source -> confidence from 0 to 1. Needles are fixed values: marks that the databases leave in their exports."""
    text, n_bib, n_ris = c("content"), _times(r"(?m)^\s*@[a-zA-Z]+\{"), _times("(?m)^TY  - ")
    when = lambda cond, v=1.0: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    return {
        "scopus": when(text.contains("source={Scopus},") | ((n_bib > 0) & (_times(r"https://www\.scopus\.com") >= n_bib))),
        "web_of_science": F.when(text.rlike(r"(?m)^@article\{ ?WOS:"), 1.0).when(text.contains("Unique-ID") | text.contains("UT WOS:"), 0.7).otherwise(0.0),
        "springer_link": when(c("source").endswith(".csv") & (_times("http://link.springer.com") > F.size(F.split(text, "\n")) - 3)),
        "ieee": when(text.contains("Date Added To Xplore"), 0.9),
        "trid": when(text.contains("UR  - https://trid.trb.org/view/"), 0.9),
        "pubmed": F.when(text.startswith("PMID,Title,Authors,Citation,First Author,Journal/Book"), 1.0).when(text.rlike("(?m)^PMID- "), 0.7).otherwise(0.0),
        "eric": when(text.rlike("(?m)^OWN *- ERIC")),
        "jstor": when((n_bib + n_ris > 0) & (_times(r"www\.jstor\.org") >= n_bib + n_ris)),
        "dblp": when((n_bib > 0) & ((_times("dblp_key") >= n_bib) | (_times("dblp computer science bibliography") >= n_bib))),
        "europe_pmc": when((n_bib > 0) & (_times("europe_pmc_id") >= n_bib)),
        "abi_inform": when((n_bib + n_ris > 0) & (_times(r"proquest\.com") >= F.greatest(n_bib, n_ris))),
        "files_dir": when(F.lower("source").endswith(".pdf")),
        "unknown_source": F.lit(0.1),
    }


def detect(texts: DataFrame) -> DataFrame:
    """(source, content) -> source, database, confidence, place: candidates, best first. If one is above 0.95, only those above 0.8 stay."""
    scores = F.array(*(F.struct(F.lit(k).alias("database"), v.cast("double").alias("confidence")) for k, v in confidences().items()))
    rows = texts.select("source", F.explode(scores).alias("s")).select("source", "s.*").filter("confidence > 0")
    top = F.max("confidence").over(Window.partitionBy("source"))
    kept = rows.withColumn("_top", top).filter((c("_top") <= 0.95) | (c("confidence") > 0.8)).drop("_top")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "database")))

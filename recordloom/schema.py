"""Vocabulary of the record model: fields, states, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNKNOWN, FORTHCOMING, ANONYMOUS = "UNKNOWN", "forthcoming", "Anonymous"

# fixed values: the fields that identify a record
IDENTIFYING = ["title", "author", "year", "journal", "booktitle", "chapter", "publisher", "volume", "number", "pages", "editor", "institution"]

# fixed values: states of a record in their order
STATES = [
    "md_retrieved", "md_imported", "md_needs_manual_preparation", "md_prepared", "md_processed", "rev_prescreen_excluded", "rev_prescreen_included",
    "pdf_needs_manual_retrieval", "pdf_imported", "pdf_not_available", "pdf_needs_manual_preparation", "pdf_prepared", "rev_excluded", "rev_included", "rev_synthesized",
]
RANK = {s: i + 1 for i, s in enumerate(STATES)}

# fixed values: states that a record has passed x in (not simply those of a higher rank)
POST = {
    "rev_synthesized": ["rev_synthesized"],
    "rev_included": ["rev_excluded", "rev_included", "rev_synthesized"],
    "pdf_prepared": ["pdf_prepared", "rev_excluded", "rev_included", "rev_synthesized"],
    "pdf_imported": ["pdf_imported", "pdf_needs_manual_preparation", "pdf_prepared", "rev_excluded", "rev_included", "rev_synthesized"],
}
POST["rev_prescreen_included"] = ["rev_prescreen_included", "rev_prescreen_excluded", "pdf_needs_manual_retrieval", "pdf_not_available", *POST["pdf_imported"]]
POST["md_processed"] = ["md_processed", *POST["rev_prescreen_included"]]
POST["md_prepared"] = ["md_prepared", *POST["md_processed"]]

# fixed values: (operation, state before, state after)
TRANSITIONS = [
    ("load", "md_retrieved", "md_imported"),
    ("prep", "md_imported", "md_needs_manual_preparation"),
    ("prep", "md_imported", "md_prepared"),
    ("prep_man", "md_needs_manual_preparation", "md_prepared"),
    ("dedupe", "md_prepared", "md_processed"),
    ("prescreen", "md_processed", "rev_prescreen_excluded"),
    ("prescreen", "md_processed", "rev_prescreen_included"),
    ("pdf_get", "rev_prescreen_included", "pdf_imported"),
    ("pdf_get", "rev_prescreen_included", "pdf_needs_manual_retrieval"),
    ("pdf_get_man", "pdf_needs_manual_retrieval", "pdf_not_available"),
    ("pdf_get_man", "pdf_needs_manual_retrieval", "pdf_imported"),
    ("pdf_prep", "pdf_imported", "pdf_needs_manual_preparation"),
    ("pdf_prep", "pdf_imported", "pdf_prepared"),
    ("pdf_prep_man", "pdf_needs_manual_preparation", "pdf_prepared"),
    ("screen", "pdf_prepared", "rev_excluded"),
    ("screen", "pdf_prepared", "rev_included"),
    ("data", "rev_included", "rev_synthesized"),
]

_COMMON = ["author", "title", "year"]
# fixed values: fields that a type of entry must have
REQUIRED = {
    "article": ["author", "title", "journal", "year", "volume", "number"],
    "inproceedings": [*_COMMON, "booktitle"],
    "incollection": [*_COMMON, "booktitle", "publisher"],
    "inbook": [*_COMMON, "chapter", "publisher"],
    "proceedings": ["booktitle", "editor", "year"],
    "conference": ["booktitle", "editor", "year"],
    "book": [*_COMMON, "publisher"],
    "phdthesis": [*_COMMON, "school"],
    "bachelorthesis": [*_COMMON, "school"],
    "thesis": [*_COMMON, "school"],
    "mastersthesis": [*_COMMON, "school"],
    "techreport": [*_COMMON, "institution"],
    "unpublished": _COMMON,
    "misc": _COMMON,
    "software": ["author", "title", "url"],
    "online": ["author", "title", "url"],
}
_REPORT = ["volume", "issue", "number", "journal", "booktitle", "isbn"]
# fixed values: fields that don't go with a type of entry
FORBIDDEN = {
    "article": ["booktitle", "isbn"],
    "inproceedings": ["issue", "number", "journal"],
    "inbook": ["journal"],
    "book": ["issue", "number", "journal"],
    "phdthesis": _REPORT,
    "masterthesis": _REPORT,
    "techreport": _REPORT,
    "unpublished": _REPORT,
    "online": ["journal", "booktitle", "isbn"],
    "misc": ["journal", "booktitle", "isbn"],
}


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "operation string, source string, dest string")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, r) for s, r in RANK.items()], "state string, state_rank int")

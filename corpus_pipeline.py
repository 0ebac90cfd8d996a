"""A training-corpus pipeline over ``documents``: stages of recordloom.llm, each written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.decontaminate import find_leaks
from recordloom.llm.language_id import document_rows, fit_documents, identify
from recordloom.llm.ngram_join import ngram_components
from recordloom.llm.pack import pack_tokens
from recordloom.llm.phrase_dedup import cut_repeats
from recordloom.session import bound_batches, materialize, release, table_of, with_table


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each (doc_id, text) as _key; nulls are values."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, found: DataFrame, key: str, label: str) -> DataFrame:
    """docs without the found keys. These are written first, so the planner joins by their measured size and texts are only exchanged when they are many."""
    ids = materialize(found.select(key).distinct(), label)
    return with_table(docs.join(ids, key, "left_anti"), table_of(ids))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, an unknown language, no clear posterior) go.

    Rows are judged one by one, also where they share a doc_id or have none.
    """
    bound_batches(spark)
    keyed = _keyed(docs)
    verdict = identify(document_rows(keyed.withColumn("doc_id", F.col("_key"))), fit_documents(docs), ["doc_id"])
    out = _without(keyed, verdict.filter("rejected is not null").select(F.col("doc_id").alias("_key")), "_key", "pipeline-rejected")
    return with_table(out.select(docs.columns), table_of(out))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (word 5-grams, Jaccard 0.75) the smallest doc_id stays.

    Rows that share a doc_id go or stay together; rows without one stay.
    """
    bound_batches(spark)
    out = _without(docs, ngram_components(docs).filter("doc_id <> component_id"), "doc_id", "pipeline-near")
    return with_table(out.select(docs.columns), table_of(out))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that start earlier in the corpus are cut; documents of which nothing is left go.

    Rows that share a doc_id and differ in text are documents of their own; rows without a doc_id stay as they are.
    """
    bound_batches(spark)
    cut, removed = cut_repeats(docs)
    hit = F.col(removed) > 0
    size = F.when(hit, F.char_length(F.trim("text")).cast("long")).otherwise(F.col("n_chars"))
    return cut.filter(~hit | (F.trim("text") != "")).withColumns({"n_chars": size, "text": F.when(hit, F.trim("text")).otherwise(F.col("text"))}).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with at most a tenth of it edited go, row by row as in language_id."""
    bound_batches(spark)
    keyed = _keyed(docs)
    leaks = find_leaks(keyed.withColumn("doc_id", F.col("_key")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = _without(keyed, leaks.select(F.col("doc_id").alias("_key")), "_key", "pipeline-leaks")
    return with_table(out.select(docs.columns), table_of(out))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1024, from every row."""
    bound_batches(spark)
    return pack_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can't express the stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        written = materialize(out, f"pipeline-{name}")
        release(docs, out)  # what the finished stage has read
        docs = written
    return docs

"""Languages told by letter trigrams: profiles counted from texts of known language, texts scored by grouped sums.

A word's trigrams are taken with a blank on either side. A profile gives each trigram a weight, the logarithm of its smoothed share in a language in thousandths, as a whole
number, so scores are exact sums. A text gets the language of the highest score, unless too few of its trigrams are known there, or it scores
far below what texts of that language do: then its language isn't among the profiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize

c = F.col
#: a longer run of letters isn't a word
LONGEST_WORD = 40


def trigrams(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts (keys, text) -> keys, gram, n. Texts without a letter have none."""
    words = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).filter(F.char_length("w") <= LONGEST_WORD)
    words = words.groupBy(*keys, "w").agg(F.count("*").alias("m"))  # a word's trigrams are made once for each key
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    grams = words.select(*keys, "m", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w")), lambda i: F.substr(padded, i, F.lit(3)))).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.sum("m").alias("n"))


@dataclass
class Profiles:
    """grams: lang, gram, weight; langs: lang, absent (the weight of a trigram that isn't there), usual (the mean weight over the language's own texts)."""

    grams: DataFrame
    langs: DataFrame


def fit_profiles(samples: DataFrame, least_rows: int = 20) -> Profiles:
    """samples (lang, text) -> profiles of the languages with at least ``least_rows`` samples. All samples count; rows without a language or text don't."""
    rows = samples.filter("lang is not null and text is not null")
    kept = rows.groupBy("lang").agg(F.count("*").alias("n_rows")).filter(c("n_rows") >= least_rows).select("lang")
    counts = materialize(trigrams(rows.join(kept, "lang"), ["lang"]), "trigrams")
    kinds = counts.agg(F.count_distinct("gram").alias("kinds"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).crossJoin(kinds)  # one row of kinds
    weight = lambda n: F.round(1000 * F.log((n + 1) / (c("total") + c("kinds")))).cast("long")
    grams = materialize(counts.join(totals, "lang").select("lang", "gram", "n", weight(c("n")).alias("weight")), "profiles")
    usual = grams.groupBy("lang").agg(F.floor(F.sum(c("n") * c("weight")) / F.sum("n")).alias("usual"))
    langs = totals.join(usual, "lang").select("lang", weight(F.lit(0)).alias("absent"), "usual")
    return Profiles(grams.select("lang", "gram", "weight"), materialize(langs, "languages"))


def tell_languages(texts: DataFrame, profiles: Profiles, keys: list[str], least_grams: int = 10, known_percent: int = 60, slack: int = 1000) -> DataFrame:
    """texts (keys, text) -> keys, lang, n_grams: lang is null where fewer than ``least_grams`` trigrams are there, under ``known_percent`` of them are known in the best language, or the mean weight is
    more than ``slack`` thousandths under that language's usual one. The first in the alphabet of equals. A row for each key that has a trigram.
    """
    own = trigrams(texts, keys)
    n = own.groupBy(*keys).agg(F.sum("n").alias("n_grams"))
    met = own.join(profiles.grams, "gram").groupBy(*keys, "lang").agg(F.sum(c("n") * c("weight")).alias("s"), F.sum("n").alias("known"))
    scored = met.join(n, keys).join(profiles.langs, "lang").withColumn("score", c("s") + (c("n_grams") - c("known")) * c("absent"))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("lang", "score", "known", "usual"), F.struct(-c("score"), c("lang"))).alias("b"))
    sure = (c("n_grams") >= least_grams) & (100 * c("b.known") >= known_percent * c("n_grams")) & (c("b.score") >= c("n_grams") * (c("b.usual") - slack))
    return n.join(best, keys, "left").select(*keys, F.when(sure, c("b.lang")).alias("lang"), "n_grams")

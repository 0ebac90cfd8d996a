"""Lookups of records in an index: equi-joins on derived keys, as-of rules, imports of decisions.

No side is broadcast by hand: adaptive execution broadcasts one whose measured size is under the session's threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators.dedupe import COMPARED, comparable, pair_labels
from recordloom.operators.similar import similar_between, word_tokens
from recordloom.session import materialize

c = F.col


def first_hit(records: DataFrame, index: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """records -> ID, index_id, via: the index record that shares the first of the keys, in their order, that hits any; the earliest of several.

    One join for all keys: both sides are unpivoted to (kind, key), the index to the earliest record of each key.
    """
    kinds = list(keys)
    entries = F.array(*(F.struct(F.lit(i).alias("kind"), v.alias("key")) for i, v in enumerate(keys.values())))
    of = index.select(F.col("ID").alias("index_id"), c("seq").alias("index_seq"), F.explode(entries).alias("k")).select("index_id", "index_seq", "k.*").filter("key is not null")
    of = of.groupBy("kind", "key").agg(F.min_by("index_id", "index_seq").alias("index_id"))
    asked = records.select("ID", F.explode(entries).alias("k")).select("ID", "k.*").filter("key is not null")
    hits = asked.join(of, ["kind", "key"]).groupBy("ID").agg(F.min(F.struct("kind", "index_id")).alias("h"))
    names = F.array(*(F.lit(k) for k in kinds))
    return records.select("ID").join(hits, "ID", "left").select("ID", c("h.index_id").alias("index_id"), F.get(names, c("h.kind")).alias("via"))


def toc_status(records: DataFrame, index: DataFrame, alike: float = 0.7, duplicate: float = 0.9) -> DataFrame:
    """ID, toc_key, index_id, result: found, not-in-toc (the issue is known but not the record) or not-in-index.

    A record is found by its title in its issue, or else as a duplicate (similarity of ``duplicate`` or more) of a record of the issue whose title's words have a Jaccard
    coefficient of ``alike`` or more: the most similar one, of equals the smallest ID.
    """
    keyed = lambda df: df.select("ID", "seq", T.toc_key().alias("toc_key"), T.slug(c("title")).alias("title_key"))
    of = keyed(index).filter("toc_key is not null")
    titles = of.groupBy("toc_key", "title_key").agg(F.min_by("ID", "seq").alias("index_id"))
    tocs = of.select("toc_key").distinct().withColumn("known", F.lit(True))
    exact = keyed(records).filter("toc_key is not null").join(titles, ["toc_key", "title_key"], "left").join(tocs, "toc_key", "left")
    exact = materialize(exact.select("ID", "toc_key", "index_id", "known"), "exact-titles")
    # words of titles, each with its issue: only records of one issue share any; who is found by title needs no duplicate
    rest = records.join(exact.filter("index_id is null and known").select("ID"), "ID", "left_semi")

    def issue_words(df: DataFrame) -> DataFrame:
        w = df.select("ID", T.toc_key().alias("toc_key"), word_tokens(c("title")).alias("w")).filter("toc_key is not null")
        return w.select("ID", F.zip_with("w", F.array_repeat("toc_key", F.size("w")), lambda w, toc: F.xxhash64(toc, w)).alias("tokens"))

    near = similar_between(issue_words(rest), issue_words(index), alike).select("a_ID", "b_ID")
    side = lambda df, n: comparable(df).select(*(c(x).alias(f"{n}_{x}") for x in ("ID", "ENTRYTYPE", *COMPARED)))
    pairs = pair_labels(near.join(side(records, "a"), "a_ID").join(side(index, "b"), "b_ID"), duplicate=duplicate).filter("label = 'duplicate'")
    best = pairs.groupBy(c("a_ID").alias("ID")).agg(F.min_by("b_ID", F.struct(-c("similarity"), c("b_ID"))).alias("near_id"))
    out = exact.join(best, "ID", "left").withColumn("index_id", F.coalesce("index_id", "near_id"))
    return out.select("ID", "toc_key", "index_id", F.when(c("index_id").isNotNull(), "found").when(c("known"), "not-in-toc").otherwise("not-in-index").alias("result"))


def same_outlet(records: DataFrame, index: DataFrame) -> DataFrame:
    """Of each record's outlet (the key without its last part), over all issues: the number of index records, and the earliest one with the record's title."""
    prefix = F.regexp_replace(T.toc_key(), r"\|[^|]*$", "")
    of = index.select(prefix.alias("outlet"), T.slug(c("title")).alias("title_key"), "ID", "seq").filter("outlet is not null")
    n = of.groupBy("outlet").agg(F.count("*").alias("n_index"))
    titles = of.filter("title_key is not null").groupBy("outlet", "title_key").agg(F.min_by("ID", "seq").alias("index_id"))
    asked = records.select("ID", prefix.alias("outlet"), T.slug(c("title")).alias("title_key")).filter("outlet is not null")
    return asked.join(n, "outlet", "left").join(titles, ["outlet", "title_key"], "left").select("ID", "outlet", F.coalesce("n_index", F.lit(0)).alias("n_index"), "index_id")


def year_of_toc(records: DataFrame, index: DataFrame) -> DataFrame:
    """The year of the first index record in the same issue."""
    years = index.select(T.toc_key().alias("toc_key"), "year", "seq").filter("toc_key is not null and year is not null").groupBy("toc_key").agg(F.min_by("year", "seq").alias("toc_year"))
    return records.select("ID", T.toc_key().alias("toc_key")).join(years, "toc_key", "left").select("ID", "toc_year")


def fields_to_remove(records: DataFrame, index: DataFrame) -> DataFrame:
    """Which of volume and number an outlet doesn't use: the first form of the issue key that the index has."""
    part = lambda f: F.coalesce(F.nullif(c(f), F.lit("UNKNOWN")), F.lit("-"))
    key = lambda v, n: F.concat_ws("|", T.slug(c("journal")), v, n)
    dash = F.lit("-")
    forms = [("", key(part("volume"), part("number"))), ("number", key(part("volume"), dash)), ("volume", key(dash, part("number"))), ("volume,number", key(dash, dash))]
    have = index.filter("ENTRYTYPE = 'article' and journal is not null").select(T.toc_key().alias("form")).distinct()
    articles = records.filter("ENTRYTYPE = 'article' and journal is not null")
    tried = articles.select("ID", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("drop"), k.alias("form")) for i, (name, k) in enumerate(forms)))).alias("f")).select("ID", "f.*")
    hit = tried.join(have, "form").groupBy("ID").agg(F.min(F.struct("i", "drop")).alias("h"))
    return articles.select("ID").join(hit, "ID", "left").select("ID", c("h.drop").alias("drop"))


def journal_ranking(records: DataFrame, rankings: DataFrame) -> DataFrame:
    """ID, journal_ranking (all ranks, or a note), predatory. rankings: journal_name, ranking, predatory."""
    by = rankings.groupBy("journal_name").agg(F.array_join(F.array_sort(F.collect_set("ranking")), ",").alias("ranks"), F.bool_or(c("predatory") == "yes").alias("bad"))
    out = records.filter("journal is not null").select("ID", "journal").join(by, c("journal") == c("journal_name"), "left")
    return out.select("ID", F.coalesce("ranks", F.lit("not included in a ranking")).alias("journal_ranking"), F.coalesce("bad", F.lit(False)).alias("predatory"))


def year_from_issue(records: DataFrame) -> DataFrame:
    """Missing years from (journal, volume, number) of other records; the last of several wins."""
    keys = ["journal", "volume", "number"]
    known = records.filter("journal is not null and volume is not null and volume <> 'UNKNOWN'").filter(c("year").rlike("^[0-9]{4}$"))
    years = known.groupBy(*keys).agg(F.max_by("year", "seq").alias("issue_year")).select(*(c(k).alias(f"k_{k}") for k in keys), "issue_year")
    on = reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(f"k_{k}")) for k in keys))
    asked = records.filter("journal is not null and volume is not null").filter(~F.coalesce(c("year").rlike("^[0-9]{4}$"), F.lit(False)))
    return asked.join(years, on, "left").select("ID", "journal", "volume", "number", "issue_year")


def as_of_rule(facts: DataFrame, rules: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """facts plus the rule of their key with the greatest start that isn't after ``at``; the first rule where none is.

    One pass of a running maximum over the union of facts and rules, so neither side is expanded: ties at one
    moment put the rule first.
    """
    rule_cols = [x for x in rules.columns if x not in (key,)]
    both = facts.select(c(key), c(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in rules.schema if f.name != key)}>").alias("_rule")).unionAll(
        rules.select(c(key), c(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(facts.select(F.struct(*facts.columns)).schema[0].dataType), F.struct(*rule_cols))
    )
    w = "partition by {k} order by _at, _side".format(k=key)
    seen = both.withColumn("_last", F.expr(f"last_value(_rule, true) over ({w} rows between unbounded preceding and current row)")).filter("_side = 1")
    first = rules.groupBy(key).agg(F.min_by(F.struct(*rule_cols), start).alias("_first"))
    out = seen.join(first, key, "left").withColumn("_r", F.coalesce("_last", "_first"))
    return out.select("_fact.*", *(c(f"_r.{x}").alias(x) for x in rule_cols))


def files_by_hash(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (ID, hash), files (hash, path) -> ID, found: the first path of equal content, if any."""
    of = files.filter("hash is not null").groupBy("hash").agg(F.min("path").alias("found"))
    return records.select("ID", "hash").join(of, "hash", "left").select("ID", "found")


def foreign_selection(records: DataFrame, condition: str) -> DataFrame:
    """Records of another project that meet a condition given as text, once for all of them; one that can't be read or names unknown fields selects none."""
    try:
        return records.where(condition)
    except (ParseException, AnalysisException):
        return records.limit(0)


def import_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (ID, decision: in, out or TODO) -> the status of records that wait for the prescreen."""
    waiting = c("status") == "md_processed"
    return records.join(decisions.select("ID", "decision"), "ID", "left").withColumn(
        "status", F.when(waiting & (c("decision") == "in"), "rev_prescreen_included").when(waiting & (c("decision") == "out"), "rev_prescreen_excluded").otherwise(c("status"))
    )


def table_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full-outer diff: key, side (left only, right only, both), changed fields. Equal rows aren't returned."""
    a = left.select(key, F.lit(1).alias("_l"), *(c(f).alias(f"l_{f}") for f in fields))
    b = right.select(key, F.lit(1).alias("_r"), *(c(f).alias(f"r_{f}") for f in fields))
    changed = F.filter(F.array(*(F.when(~c(f"l_{f}").eqNullSafe(c(f"r_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    out = a.join(b, key, "full_outer").select(
        key, F.when(c("_l").isNull(), "right only").when(c("_r").isNull(), "left only").otherwise("both").alias("side"),
        F.when(c("_l").isNotNull() & c("_r").isNotNull(), F.array_join(changed, ",")).otherwise("").alias("changed"),
    )
    return out.filter("side <> 'both' or changed <> ''")

"""Preparation of loaded records: repairs, inheritance, clamps, names, paths, enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.history import unique_suffix
from recordloom.schema import REQUIRED

c = F.col

# fixed values: particles of names, longest first
PARTICLES = ["van den", "von den", "van der", "von der", "vom", "van", "von"]


def clamp_entrytype(col: Column) -> Column:
    """Known types as they are, everything else misc."""
    low = F.lower(col)
    return F.when(low.isin(list(REQUIRED)), low).otherwise("misc")


def repair_ids(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Spaces and semicolons in ids become underscores; ids that repeat get a, b, ... appended."""
    base = F.regexp_replace("local_id", "[ ;]", "_")
    n = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return rows.withColumn("_b", base).withColumn("local_id", F.concat("_b", unique_suffix(n))).drop("_b")


def inherit(records: DataFrame, fields: list[str], parent: str = "crossref") -> DataFrame:
    """Children take the fields that they lack from the entry that they name; entries named by a child are left out."""
    p = records.select(c("ID").alias("_pid"), *(c(f).alias(f"_p_{f}") for f in fields))
    named = records.filter(c(parent).isNotNull()).select(c(parent).alias("ID")).distinct()
    out = records.join(p, c(parent) == c("_pid"), "left").withColumns({f: F.coalesce(c(f), c(f"_p_{f}")) for f in fields}).drop("_pid", *(f"_p_{f}" for f in fields))
    return out.join(named, "ID", "left_anti")


def import_violations(rows: DataFrame) -> DataFrame:
    """Loaded rows (local_id, ENTRYTYPE, fields) that break the rules of an import: local_id, problem."""
    keys = F.map_keys("fields")
    problems = F.array_compact(F.array(
        F.when(c("local_id").isNull(), F.lit("no ID")), F.when(c("ENTRYTYPE").isNull(), F.lit("no ENTRYTYPE")),
        F.when(F.exists(keys, lambda k: (F.lower(k) != k) | k.contains(" ")), F.lit("field name")),
        F.when(F.exists(F.map_values("fields"), lambda v: v.isNull() | (v == "")), F.lit("empty value")),
        F.when(F.exists(keys, lambda k: k.contains("provenance")), F.lit("provenance field")),
    ))
    return rows.select("local_id", F.explode(problems).alias("problem"))


def brace_particles(author: Column) -> Column:
    """Last names that begin with a particle are put in braces."""

    def one(name: Column) -> Column:
        out = None
        for p in PARTICLES:
            start = F.when(name.contains(","), F.concat(F.lit("{"), F.replace(name, F.lit(", "), F.lit("}, ")))).otherwise(F.concat(F.lit("{"), name, F.lit("}")))
            out = F.when(name.startswith(p + " "), start) if out is None else out.when(name.startswith(p + " "), start)
        for p in PARTICLES:
            rest = F.rtrim(F.substring(name, F.lit(1), F.char_length(name) - len(p)))
            end = F.when(name.contains(","), F.concat(F.lit("{" + p + " "), F.replace(rest, F.lit(", "), F.lit("}, ")))).otherwise(F.concat(F.lit("{" + p + " "), rest, F.lit("}")))
            out = out.when(name.endswith(" " + p), end)
        return out.otherwise(name)

    return F.array_join(F.transform(F.split(author, " and "), one), " and ")


def comma_names(author: Column) -> Column:
    """Names as "Last, First": lists split at and, semicolons or several commas; years that tell namesakes apart are dropped."""
    text = F.trim(F.regexp_replace(F.regexp_replace(author, "\n", " "), "[0-9]{4}", ""))
    count = lambda ch: F.char_length(text) - F.char_length(F.replace(text, F.lit(ch), F.lit("")))
    names = F.when(text.contains(" and "), F.split(text, " and ")).when(count(";") > 1, F.split(text, ";")).when(count(",") > 1, F.split(text, ",")).otherwise(F.array(text))

    def one(n: Column) -> Column:
        n = F.trim(n)
        words = F.split(n, r"\s+")
        first = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
        return F.when(n.contains(",") | ~n.contains(" "), n).otherwise(F.concat(F.element_at(words, -1), F.lit(", "), first))

    joined = F.array_join(F.transform(F.filter(names, lambda n: F.trim(n) != ""), one), " and ")
    capital = F.transform(F.split(joined, " "), lambda w: F.when(w.isin("and"), w).otherwise(F.initcap(w)))
    letters = F.regexp_replace(joined, "( and )|[^a-zA-Z]", "")
    return F.when((letters == F.upper(letters)) & (letters != ""), F.array_join(capital, " ")).otherwise(joined)


def path_parts(path: Column) -> dict[str, Column]:
    """Year, volume and number from the folders of a path."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    get = lambda pattern, i: F.nullif(F.regexp_extract(folder, pattern, i), F.lit(""))
    return {"year": get("(?:^|/)([1-2][0-9]{3})(?:/|$)", 1), "volume": get("(?:^|/)([0-9]{1,3})(?:_[0-9]{1,2})?(?:/|$)", 1), "number": get("(?:^|/)[0-9]{1,3}_([0-9]{1,2})(?:/|$)", 1)}


def fix_entrytype() -> Column:
    """Heuristics for records of unknown sources: theses by their words, publishers of books."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    return (
        F.when((c("ENTRYTYPE") == "misc") & c("publisher").isNotNull(), "book")
        .when(text.contains("this thesis") | F.lower(F.coalesce("url", F.lit(""))).rlike("dissertation|thesis"), "phdthesis")
        .when((c("ENTRYTYPE") == "article") & c("journal").isNull() & c("booktitle").isNotNull(), "inproceedings").otherwise(c("ENTRYTYPE"))
    )


def clean_article() -> dict[str, Column]:
    """Journal in capitals as a title, volume and number without their words."""
    from recordloom.functions.text import percent_upper

    return {
        "journal": F.when((F.char_length("journal") > 10) & (percent_upper(c("journal")) >= 0.6), F.initcap(F.lower("journal"))).otherwise(c("journal")),
        "volume": F.replace(c("volume"), F.lit("Volume "), F.lit("")),
    }


def enrich(records: DataFrame, metadata: DataFrame, key: str, fields: list[str], threshold: float = 0.8) -> DataFrame:
    """Fill fields from metadata with the same key, if the titles match; a key whose metadata doesn't match is dropped.

    metadata: the key, title and the fields, one row for each key.
    """
    from recordloom.functions.similarity import ratio_bound, ratio_udf

    m = metadata.select(c(key).alias("_k"), c("title").alias("_t"), *(c(f).alias(f"_m_{f}") for f in fields)).dropDuplicates(["_k"])
    both = records.join(m, c(key) == c("_k"), "left")
    asked = F.when(c("_t").isNotNull() & c("title").isNotNull() & (ratio_bound(c("title"), c("_t")) >= 100 * threshold), F.lower("title"))
    both = both.withColumn("_r", ratio_udf(asked, F.lower("_t")))
    ok = F.coalesce(c("_r") >= 100 * threshold, F.lit(False))
    missing = lambda f: c(f).isNull() | c(f).isin("", "UNKNOWN")
    out = {f: F.when(ok & missing(f), F.coalesce(c(f"_m_{f}"), c(f))).otherwise(c(f)) for f in fields}
    out[key] = F.when(c("_k").isNotNull() & ~ok, F.lit(None).cast("string")).otherwise(c(key))
    return both.withColumns(out | {"linked": ok}).drop("_k", "_t", "_r", *(f"_m_{f}" for f in fields))


def retracted() -> Column:
    """Marks of retraction."""
    return F.coalesce(reduce(lambda a, b: a | b, (c("title").startswith("RETRACTED"), c("title").contains("(retracted)"), F.coalesce(c("abstract"), F.lit("")).contains("Withdrawn"))), F.lit(False))

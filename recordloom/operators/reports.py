"""Aggregated reports: crosstabs with margins, top lists, grids, agreement, flow counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def crosstab(df: DataFrame, row: str, column: str, margin: str = "All") -> DataFrame:
    """row, column, n for all pairs of values with margins (value ``margin``): the long form of a pivot table. Null values are left out."""
    both = df.filter(c(row).isNotNull() & c(column).isNotNull())
    out = both.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    label = lambda f, g: F.when(c(g) == 1, margin).otherwise(c(f).cast("string")).alias(f)
    return out.select(label(row, "_r"), label(column, "_c"), "n")


def outlet_by_year(records: DataFrame) -> DataFrame:
    """outlet, years, counts and total: one row for each outlet and "All"; years without records between the first and last count 0."""
    r = records.filter(c("year").rlike("^[0-9]{4}$")).select(F.coalesce("journal", "booktitle").alias("outlet"), c("year").cast("int").alias("year")).filter("outlet is not null")
    n = r.groupBy("outlet", "year").agg(F.count("*").alias("n"))
    n = n.unionByName(n.groupBy("year").agg(F.sum("n").alias("n")).withColumn("outlet", F.lit("All")))
    span = n.agg(F.min("year").alias("a"), F.max("year").alias("b"))  # one row
    by = n.groupBy("outlet").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"), F.sum("n").alias("total"))  # at most one entry a year
    counts = F.transform(F.sequence("a", "b"), lambda y: F.coalesce(F.try_element_at(c("m"), y), F.lit(0)))
    return by.crossJoin(span).select("outlet", c("a").alias("first_year"), F.array_join(counts.cast("array<string>"), ",").alias("counts"), "total")


def top_values(df: DataFrame, field: str, k: int = 10, above: int = 5) -> DataFrame:
    """The k most frequent values among those that occur more than ``above`` times."""
    return df.filter(c(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).filter(c("n") > above).orderBy(F.desc("n"), field).limit(k)


def keyword_counts(df: DataFrame, field: str, above: int = 2, stop: list[str] | None = None) -> DataFrame:
    words = df.select(F.explode(F.split(field, ", ")).alias("keyword")).filter("keyword <> ''")
    if stop:
        words = words.filter(~c("keyword").isin(stop))
    return words.groupBy("keyword").agg(F.count("*").alias("n")).filter(c("n") > above)


def threshold_grid(citations: DataFrame, steps: int = 19) -> DataFrame:
    """citations (ref, paper, n_intext) -> i, j, n: references that at least j papers cite at least i times each.

    Mentions beyond the last step count as that many, so a reference has at most ``steps`` counts, one for each number of mentions; the grid is counted from histograms, not by a
    join of the table with the grid.
    """
    counts = citations.filter("n_intext >= 1").groupBy("ref", F.least(c("n_intext"), F.lit(steps)).alias("q")).agg(F.count("*").alias("n"))
    # the counts of a reference are few, however many cite it, and need no further partial sums
    papers = F.array(*(F.struct(F.lit(i).alias("i"), F.sum(F.when(c("q") >= i, c("n"))).alias("m")) for i in range(1, steps + 1)))
    by_i = counts.repartition("ref").groupBy("ref").agg(papers.alias("p")).select(F.explode("p").alias("p")).select("p.*").filter("m is not null")
    hist = by_i.groupBy("i", F.least("m", F.lit(steps)).alias("m")).agg(F.count("*").alias("n"))
    cells = hist.select("i", F.explode(F.sequence(F.lit(1), c("m").cast("int"))).alias("j"), "n")
    return cells.groupBy("i", "j").agg(F.sum("n").alias("n"))


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """n records that both coders decided, and the share of equal decisions."""
    both = a.select(key, c(label).alias("x")).join(b.select(key, c(label).alias("y")), key)
    return both.agg(F.count("*").alias("n"), F.avg((c("x") == c("y")).cast("double")).alias("agreement"))


def ambiguous(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Keys with more than one decision that differ."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_labels")).filter("n > 1 and n_labels > 1")


def shared_origins(records: DataFrame) -> DataFrame:
    """Origins of sources other than metadata ones that more than one record claims."""
    o = records.select("ID", F.explode(F.split("origins", ";")).alias("origin")).filter(~c("origin").startswith("md_"))
    return o.groupBy("origin").agg(F.count_distinct("ID").alias("n"), F.min("ID").alias("first_id")).filter("n > 1")


def synthesised(decisions: DataFrame) -> DataFrame:
    """decisions (ID, endpoint, done) -> ID, status: synthesised once every endpoint is done."""
    return decisions.groupBy("ID").agg(F.when(F.bool_and("done"), "rev_synthesized").otherwise("rev_included").alias("status"))


def source_matrix(records: DataFrame) -> DataFrame:
    """outlet, source, n_imported, n_processed, n_prepared (records of each source in the outlet by how far they are)."""
    from recordloom.schema import POST

    o = records.filter("status <> 'rev_prescreen_excluded'").select(
        F.coalesce("journal", "booktitle").alias("outlet"), "status", F.explode(F.transform(F.split("origins", ";"), lambda x: F.split_part(x, F.lit("/"), F.lit(1)))).alias("source")
    )
    return o.filter("outlet is not null").groupBy("outlet", "source").agg(
        F.count_if(c("status") == "md_imported").alias("n_imported"), F.count_if(c("status").isin(POST["md_processed"])).alias("n_processed"), F.count_if(c("status").isin(POST["pdf_prepared"])).alias("n_prepared")
    )


def incomplete_rows(rows: DataFrame, key: str, fields: list[str], open_mark: str = "TODO") -> DataFrame:
    """Ids of a structured table that stand in several rows (n) or have a field that is still to do (open)."""
    todo = F.lit(False)
    for f in fields:
        todo = todo | F.coalesce(F.col(f) == open_mark, F.lit(False))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bool_or(todo).alias("open")).filter("n > 1 or open")

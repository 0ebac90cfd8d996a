"""Versions of a record set, encoded as intervals: a row for each state of a record, with the first version that has it and the first that no longer does.

A version costs the rows that it changes, whatever the number of versions; a version, what two differ in, and what a record once was are selections of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize

c = F.col
FROM, TO = "valid_from", "valid_to"


def _digest(fields: list[str]) -> Column:
    """Equal where all fields are (null is a value of its own)."""
    return F.sha2(F.to_json(F.struct(*(c(f) for f in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def first_version(records: DataFrame, number: int = 0) -> DataFrame:
    """records (ID, fields) -> their intervals: ID, fields, valid_from, valid_to (null: still valid)."""
    return records.withColumns({FROM: F.lit(number), TO: F.lit(None).cast("int")})


def next_version(intervals: DataFrame, records: DataFrame, number: int) -> DataFrame:
    """The intervals with a further version, ``number``, which has exactly the given records.

    Open intervals and records meet in one full outer join on the ID: equal ones stay open, others are closed and opened anew. Closed intervals pass by.
    """
    fields = [f for f in intervals.columns if f not in (FROM, TO)]
    old = intervals.filter(c(TO).isNull()).select(F.struct(*fields).alias("_o"), c(FROM).alias("_from"), c("ID").alias("_oid"), _digest(fields).alias("_od"))
    new = records.select(*fields).select(F.struct(*fields).alias("_n"), c("ID").alias("_nid"), _digest(fields).alias("_nd"))
    both = old.join(new, c("_oid") == c("_nid"), "full_outer")
    kept = F.coalesce(c("_od") == c("_nd"), F.lit(False))
    row = lambda what, start, end: F.struct(c(what).alias("r"), start.alias(FROM), end.cast("int").alias(TO))
    stays = F.when(c("_oid").isNotNull(), row("_o", c("_from"), F.when(~kept, F.lit(number))))
    opens = F.when(c("_nid").isNotNull() & ~kept, row("_n", F.lit(number), F.lit(None)))
    changed = both.select(F.explode(F.array_compact(F.array(stays, opens))).alias("x")).select("x.r.*", f"x.{FROM}", f"x.{TO}")
    return intervals.filter(c(TO).isNotNull()).unionByName(changed)


def at_version(intervals: DataFrame, number: int) -> DataFrame:
    """The records of a version."""
    return intervals.filter((c(FROM) <= number) & (c(TO).isNull() | (c(TO) > number))).drop(FROM, TO)


def version_diff(intervals: DataFrame, before: int, after: int) -> DataFrame:
    """ID, change (added, removed or changed): what differs between two versions. Only intervals that begin or end between them are compared."""
    fields = [f for f in intervals.columns if f not in (FROM, TO)]
    touched = intervals.filter(((c(FROM) > before) & (c(FROM) <= after)) | ((c(TO) > before) & (c(TO) <= after)))
    valid = lambda n: (c(FROM) <= n) & (c(TO).isNull() | (c(TO) > n))
    d = touched.withColumn("_d", _digest(fields)).groupBy("ID").agg(F.max(F.when(valid(before), c("_d"))).alias("a"), F.max(F.when(valid(after), c("_d"))).alias("b"))
    kind = F.when(c("a").isNull(), "added").when(c("b").isNull(), "removed").otherwise("changed")
    return d.filter("not (a <=> b)").select("ID", kind.alias("change"))


def _origins(value: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(value, ";"), lambda o: o != "")))


def changed_in(intervals: DataFrame, number: int) -> DataFrame:
    """ID, changed: of each record of a version, whether it differs from all records of the version before that share an origin with it; new records aren't changed."""
    now = intervals.filter((c(FROM) <= number) & (c(TO).isNull() | (c(TO) > number)))
    begun = now.filter(c(FROM) == number).select("ID", F.explode(_origins(c("origins"))).alias("origin"))
    before = at_version(intervals, number - 1).select(F.explode(_origins(c("origins"))).alias("origin")).distinct()
    changed = begun.join(before, "origin", "left_semi").select("ID").distinct().withColumn("changed", F.lit(True))
    return now.select("ID").join(changed, "ID", "left").select("ID", F.coalesce("changed", F.lit(False)).alias("changed"))


def unmerge(intervals: DataFrame, ids: DataFrame, status: str = "md_processed") -> DataFrame:
    """The newest version's records after the last merge of the given ones (ids: ID) is taken back.

    Each is followed back to the last version in which it had other origins, or in which it wasn't there; all records of that version that share an origin with it
    come back, with ``status``, in its place. Changes of other fields since the merge don't end the search. Records that are still there under their ID aren't brought
    back twice; a record for which no earlier one is found stays as it is.
    """
    fields = [f for f in intervals.columns if f not in (FROM, TO)]
    own = intervals.join(ids.select("ID").distinct(), "ID", "left_semi").withColumn("_set", _origins(c("origins")))
    now = own.filter(c(TO).isNull()).select("ID", c("_set").alias("_now"))
    # the version in which the present origins came about
    merged = own.join(now, "ID").groupBy("ID", "_now").agg(F.coalesce(F.max(F.when(~c("_set").eqNullSafe(c("_now")), c(TO))), F.min(FROM)).alias("_merged_at"))
    wanted = merged.select(c("ID").alias("_merged"), (c("_merged_at") - 1).alias("_v"), F.explode("_now").alias("_origin"))
    held = intervals.select("*", F.explode(_origins(c("origins"))).alias("_origin"))
    found = held.join(wanted, "_origin").filter((c(FROM) <= c("_v")) & (c(TO).isNull() | (c(TO) > c("_v"))))
    # a record that several share is the newest of its versions
    back = found.groupBy("ID").agg(F.max_by(F.struct(*fields), c(FROM)).alias("r"), F.collect_set("_merged").alias("_for"))
    back = materialize(back, "unmerged")
    gone = back.select(F.explode("_for").alias("ID")).distinct()
    stays = intervals.filter(c(TO).isNull()).select(*fields).join(gone, "ID", "left_anti")
    restored = back.select("r.*").withColumn("status", F.lit(status)).join(stays.select("ID"), "ID", "left_anti")
    return stays.unionByName(restored.select(*fields))

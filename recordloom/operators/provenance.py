"""Field provenance: maps of field -> (source, note), where a note is a comma-joined set of defect codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.schema import REQUIRED

c = F.col


def parse_cell(cell: Column) -> Column:
    """Text "field:source;note; field:source;note;" as a map of field -> struct(source, note). Items without a colon are left out."""
    items = F.filter(F.split(F.trim(cell), "; "), lambda x: x.contains(":"))
    return F.map_from_entries(
        F.transform(
            items,
            lambda x: F.struct(
                F.split_part(x, F.lit(":"), F.lit(1)).alias("field"),
                F.struct(
                    F.split_part(F.substr(x, F.instr(x, ":") + 1), F.lit(";"), F.lit(1)).alias("source"),
                    F.split_part(F.substr(x, F.instr(x, ":") + 1), F.lit(";"), F.lit(2)).alias("note"),
                ),
            ),
        )
    )


def _codes(note: Column) -> Column:
    return F.filter(F.split(note, ","), lambda n: n != "")


def add_note(note: Column, code: str) -> Column:
    """The note with the code added unless it is there."""
    return F.when(F.coalesce(note, F.lit("")) == "", code).when(F.array_contains(F.split(note, ","), code), note).otherwise(F.concat(note, F.lit(f",{code}")))


def remove_note(note: Column, code: str) -> Column:
    """The note without the code and its IGNORE form; unchanged if the code itself isn't there."""
    codes = F.split(note, ",")
    return F.when(F.array_contains(codes, code), F.array_join(F.filter(codes, lambda n: ~n.isin(code, f"IGNORE:{code}")), ",")).otherwise(note)


def ignore_note(note: Column, code: str) -> Column:
    return add_note(remove_note(note, code), f"IGNORE:{code}")


def has_defects(note: Column, strict_parity: bool = False) -> Column:
    """Whether a note names a defect that isn't ignored. With ``strict_parity`` an empty note counts as one, as the reference's field check has it."""
    codes = F.split(F.coalesce(note, F.lit("")), ",") if strict_parity else _codes(F.coalesce(note, F.lit("")))
    return F.exists(codes, lambda n: ~n.startswith("IGNORE:"))


def update_field(records: DataFrame, key: str, value: Column, source: str, note: str = "", append: bool = False, keep_source_if_equal: bool = True) -> DataFrame:
    """Set a field and its provenance (column prov); an equal value changes nothing."""
    same = c(key).eqNullSafe(value) if keep_source_if_equal else F.lit(False)
    old = F.coalesce(F.try_element_at("prov", F.lit(key))["source"], F.lit("original"))
    entry = F.create_map(F.lit(key), F.struct((F.concat(old, F.lit(f"|{source}")) if append else F.lit(source)).alias("source"), F.lit(note).alias("note")))
    rest = F.map_filter("prov", lambda k, _: k != key)
    return records.withColumns({key: F.when(same, c(key)).otherwise(value), "prov": F.when(same, c("prov")).otherwise(F.map_concat(rest, entry))})


def rename_field(records: DataFrame, key: str, new: str) -> DataFrame:
    """Move a value and its provenance."""
    has = c(key).isNotNull()
    moved = F.struct(F.concat(F.coalesce(F.try_element_at("prov", F.lit(key))["source"], F.lit("ORIGINAL")), F.lit(f"|rename-from:{key}")).alias("source"), F.coalesce(F.try_element_at("prov", F.lit(key))["note"], F.lit("")).alias("note"))
    prov = F.map_concat(F.map_filter("prov", lambda k, _: ~k.isin(key, new)), F.create_map(F.lit(new), moved))
    return records.withColumns({new: F.when(has, c(key)).otherwise(c(new)), key: F.lit(None).cast("string"), "prov": F.when(has, prov).otherwise(c("prov"))})


def align(records: DataFrame, fields: list[str]) -> DataFrame:
    """Provenance for exactly the fields that a record has: orphans go, others get the source manual."""
    present = F.array_compact(F.array(*(F.when(c(f).isNotNull(), F.lit(f)) for f in fields)))
    kept = F.map_filter("prov", lambda k, _: F.array_contains(present, k))
    new = F.filter(present, lambda f: ~F.array_contains(F.map_keys("prov"), f))
    added = F.map_from_arrays(new, F.transform(new, lambda f: F.struct(F.lit("manual").alias("source"), F.lit("").alias("note"))))
    return records.withColumn("prov", F.map_concat(kept, added))


def change_entrytype(records: DataFrame, new: str) -> DataFrame:
    """A new type of entry: container moved, UNKNOWN dropped, required fields that are absent set UNKNOWN with the note missing."""
    fields = ["author", "title", "year", "journal", "booktitle", "volume", "number", "publisher", "school"]
    val = {f: F.when(c(f) == "UNKNOWN", F.lit(None)).otherwise(c(f)) for f in fields}
    if new in ("inproceedings", "proceedings"):
        moved = val["journal"].isNotNull() & val["booktitle"].isNull()
        val["booktitle"], val["journal"] = F.coalesce(val["booktitle"], val["journal"]), F.when(~moved, val["journal"])
    elif new == "article":
        val["journal"], val["booktitle"] = F.coalesce(val["booktitle"], val["journal"]), F.lit(None).cast("string")
    need = [f for f in REQUIRED.get(new, []) if f in fields]
    missing = F.array_compact(F.array(*(F.when(val[f].isNull(), F.lit(f)) for f in need)))
    same = c("ENTRYTYPE") == new
    out = {f: F.when(same, c(f)).otherwise(F.coalesce(v, F.lit("UNKNOWN")) if f in need else v) for f, v in val.items()}
    return records.withColumns(out | {"ENTRYTYPE": F.lit(new), "missing_fields": F.when(~same, F.array_join(missing, ",")).otherwise("")})


def worklist(records: DataFrame) -> DataFrame:
    """ID, field, note of what has to be prepared by hand."""
    return records.select("ID", F.explode("prov").alias("field", "p")).select("ID", "field", c("p.note").alias("note")).filter("note <> '' and note <> 'IGNORE:missing'")

"""Provenance and preparation queries (P4-P8, P12-P13, P31-P33, S7-S9, S17, F10, F14, F23, J10-J15, J23-J24), with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import dedupe as D
from recordloom.operators import prep as P
from recordloom.operators import lookup as L
from recordloom.operators import provenance as V
from recordloom.operators import transfer as O
from recordloom.plans.fixtures import records, with_records
from recordloom.plans.scalars import DOI_SQL, LCS_SQL, UPPER_SQL

c = F.col

NOTE_SQL = "case seq % 5 when 0 then 'missing' when 1 then 'IGNORE:missing' when 2 then '' when 3 then 'missing,year-format,IGNORE:missing' else 'year-format,mostly-all-caps' end"
CELL_SQL = f"'title:src.bib/' || cast(seq as string) || ';' || {NOTE_SQL} || '; year:manual;; author:ORIGINAL;incomplete-field;'"


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.withColumns({"note": F.expr(NOTE_SQL), "prov": V.parse_cell(F.expr(CELL_SQL))})


def _prov(df: DataFrame) -> DataFrame:
    return df.select("ID", F.explode("prov").alias("field", "p")).select("ID", "field", "p.source", "p.note")


def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prov(_noted(spark, sf_dir))


def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prov(V.update_field(_noted(spark, sf_dir), "year", F.when(c("seq") % 3 == 0, "2001").otherwise(c("year")), "editor", append=True).filter("year is not null"))


def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prov(V.rename_field(_noted(spark, sf_dir).withColumn("edition", F.lit(None).cast("string")), "year", "edition"))


def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prov(V.align(_noted(spark, sf_dir), ["title", "year", "journal", "doi"]))


def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("ID", V.add_note(c("note"), "missing").alias("added"), V.remove_note(c("note"), "missing").alias("removed"), V.ignore_note(c("note"), "missing").alias("ignored"))


def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("ID", V.has_defects(c("note")).alias("defects"), V.has_defects(c("note"), strict_parity=True).alias("field_check"))


def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("title", F.when(c("seq") % 17 == 0, F.concat(F.lit("RETRACTED: "), "title")).otherwise(c("title")))
    return r.select("ID", P.retracted().alias("retracted"))


def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.change_entrytype(records(spark, sf_dir), "article").select("ID", "ENTRYTYPE", "journal", "booktitle", "volume", "missing_fields")


def p31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.worklist(_noted(spark, sf_dir))


def p33(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.path_parts(c("file"))
    return records(spark, sf_dir).filter("file is not null").select("ID", *(v.alias(k) for k, v in parts.items()))


def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("ID", "seq", F.concat(F.lit("key "), F.floor(c("seq") / 4).cast("string"), F.lit(";x")).alias("local_id"))
    return P.repair_ids(rows).select("ID", "local_id")


def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("crossref", F.when(c("seq") % 10 != 0, F.concat(F.lit("R"), F.lpad((F.floor(c("seq") / 10) * 10).cast("string"), 7, "0"))))
    return P.inherit(r, ["booktitle", "publisher", "year"]).select("ID", "booktitle", "publisher", "year")


def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("raw", F.when(c("seq") % 3 == 0, F.upper("ENTRYTYPE")).when(c("seq") % 3 == 1, "electronic").otherwise(c("ENTRYTYPE")))
    return r.groupBy(P.clamp_entrytype(c("raw")).alias("ENTRYTYPE")).agg(F.count("*").alias("n"))


def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.array_join(F.transform(F.split("author", " and "), lambda n: F.trim(F.concat(F.trim(F.split_part(n, F.lit(","), F.lit(2))), F.lit(" "), F.split_part(n, F.lit(","), F.lit(1))))), "; ")
    return records(spark, sf_dir).filter("author like '% and % and %'").select("ID", P.comma_names(plain).alias("author"))


def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", P.brace_particles(c("author")).alias("author"))


def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", P.fix_entrytype().alias("ENTRYTYPE"), *(v.alias(k) for k, v in P.clean_article().items()))


def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New records that an earlier one has the key of, in the same issue."""
    r = records(spark, sf_dir).withColumns({"key": T.record_key(), "toc": T.toc_key()}).filter("key is not null and toc is not null")
    new = r.filter("status in ('md_imported', 'md_prepared')").select(c("ID").alias("a_ID"), "toc", "key")
    return new.join(r.filter("status not in ('md_imported', 'md_prepared')").select(c("ID").alias("b_ID"), "toc", "key"), ["toc", "key"]).select("a_ID", "b_ID")


def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the source rows that they come from."""
    o = records(spark, sf_dir).select("ID", F.explode(F.split("origins", ";")).alias("origin"))
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat("source", F.lit(".bib/"), F.lpad(c("doc_id").cast("string"), 6, "0")).alias("origin"), "n_chars")
    return o.join(src, "origin", "left").select("ID", "origin", "n_chars")


def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in one issue whose titles are alike."""
    return D.alike_titles(records(spark, sf_dir), 95.0)


def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a file linked to files of the same content, by its hash."""
    r = records(spark, sf_dir).withColumn("hash", F.sha2(c("text").cast("binary"), 256))
    return L.files_by_hash(r.filter("file is null"), r.filter("file is not null").select("hash", c("file").alias("path")))


def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unprocessed records enriched by the processed ones: by DOI, and by title where there is none."""
    r = records(spark, sf_dir).select("ID", "processed", T.normalise_doi(c("doi")).alias("doi"), "title", "volume", "year")
    meta = r.filter("processed").select("doi", "title", "volume", "year")
    return O.enrich_records(r.filter("not processed"), meta, ["volume", "year"], 0.5).select("ID", "doi", "volume", "year", "via")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "S7_provenance_cells": s7, "P4_update_field": p4, "P5_rename_field": p5, "P6_align_provenance": p6, "P7_notes": p7, "P8_quality_defects": p8, "P12_retracted": p12, "P13_change_entrytype": p13,
        "P31_worklist": p31, "P33_path_parts": p33, "S8_repair_ids": s8, "S9_inheritance": s9, "S17_entrytype_clamp": s17, "F10_comma_names": f10, "F14_particles": f14, "F23_unknown_source": f23,
        "J10_same_issue_key": j10, "J13_source_rows": j13, "J15_merge_candidates": j15, "J23_files_by_hash": j23, "J24_enrichment": j24,
    }


def oracle_sql() -> dict[str, str]:
    from recordloom.plans.linking import words_sql as words
    from recordloom.plans.scalars import KEY_SQL, TOC_SQL

    filled = lambda f, m: f"case when (j.{f} is null or j.{f} in ('', 'UNKNOWN')) and ok then coalesce({m}, j.{f}) when (j.{f} is null or j.{f} in ('', 'UNKNOWN')) and b.ID is not null then coalesce(b.{f}, j.{f}) else j.{f} end as {f}"

    prov = f"p as (select ID, seq, year, title, journal, doi, unnest([struct_pack(field := 'title', source := 'src.bib/' || cast(seq as string), note := {NOTE_SQL}), struct_pack(field := 'year', source := 'manual', note := ''), struct_pack(field := 'author', source := 'ORIGINAL', note := 'incomplete-field')], recursive := true) from r)"
    add = "case when {n} = '' then '{c}' when list_contains(string_split({n}, ','), '{c}') then {n} else {n} || ',{c}' end"
    rem = "case when list_contains(string_split(note, ','), 'missing') then array_to_string(list_filter(string_split(note, ','), lambda x: x not in ('missing', 'IGNORE:missing')), ',') else note end"
    unk = lambda f: f"nullif({f}, 'UNKNOWN')"
    journal = f"coalesce({unk('booktitle')}, {unk('journal')})"
    need = {"author": unk("author"), "title": unk("title"), "journal": journal, "year": unk("year"), "volume": unk("volume"), "number": unk("number")}
    missing = "array_to_string(list_filter([" + ", ".join(f"case when {v} is null then '{f}' end" for f, v in need.items()) + "], lambda x: x is not null), ',')"
    suffix = "case when n = 1 then '' else chr(cast(n - 2 + 97 as integer)) end"
    part = ""
    for p in P.PARTICLES:
        part += f" when n like '{p} %' then case when n like '%,%' then '{{' || replace(n, ', ', '}}, ') else '{{' || n || '}}' end"
    for p in P.PARTICLES:
        rest = f"rtrim(substr(n, 1, length(n) - {len(p)}))"
        part += f" when n like '% {p}' then case when n like '%,%' then '{{{p} ' || replace({rest}, ', ', '}}, ') else '{{{p} ' || {rest} || '}}' end"
    text = "lower(concat_ws(' ', title, abstract))"
    etype = f"case when ENTRYTYPE = 'misc' and publisher is not null then 'book' when {text} like '%this thesis%' or regexp_matches(lower(coalesce(url, '')), 'dissertation|thesis') then 'phdthesis' when ENTRYTYPE = 'article' and journal is null and booktitle is not null then 'inproceedings' else ENTRYTYPE end"
    title_case = "array_to_string(list_transform(string_split(lower(journal), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    ratio = lambda a, b: f"(case when {a} = '' and {b} = '' then 100.0 when {a} = '' or {b} = '' then 0.0 else 200.0 * {LCS_SQL.format(a=a, b=b)} / (length({a}) + length({b})) end)"
    flip = "list_transform(string_split(author, ' and '), lambda n: trim(trim(split_part(n, ',', 2)) || ' ' || split_part(n, ',', 1)))"
    back = "case when n like '% %' then list_last(string_split(n, ' ')) || ', ' || array_to_string(string_split(n, ' ')[1:len(string_split(n, ' ')) - 1], ' ') else n end"
    folder = "regexp_replace(file, '/[^/]*$', '')"
    src = "source || '.bib/' || lpad(cast(doc_id as string), 6, '0')"
    return {k: with_records(v) for k, v in {
        "S7_provenance_cells": f"with {prov} select ID, field, source, note from p",
        "P4_update_field": f"with {prov}, u as (select *, year is distinct from (case when seq % 3 = 0 then '2001' else year end) as ch, case when seq % 3 = 0 then '2001' else year end as y2 from p) select ID, field, case when field = 'year' and ch then source || '|editor' else source end as source, note from u where y2 is not null",
        "P5_rename_field": f"with {prov} select ID, case when field = 'year' and year is not null then 'edition' else field end as field, case when field = 'year' and year is not null then source || '|rename-from:year' else source end as source, note from p",
        "P6_align_provenance": f"with {prov} select ID, field, source, note from p where (field = 'title' and title is not null) or (field = 'year' and year is not null) union all select ID, 'journal', 'manual', '' from r where journal is not null union all select ID, 'doi', 'manual', '' from r where doi is not null",
        "P7_notes": f"with n as (select ID, {NOTE_SQL} as note from r), m as (select *, {rem} as rem from n) select ID, {add.format(n='note', c='missing')} as added, rem as removed, {add.format(n='rem', c='IGNORE:missing')} as ignored from m",
        "P8_quality_defects": f"with n as (select ID, {NOTE_SQL} as note from r) select ID, len(list_filter(string_split(note, ','), lambda x: x <> '' and not starts_with(x, 'IGNORE:'))) > 0 as defects, len(list_filter(string_split(note, ','), lambda x: not starts_with(x, 'IGNORE:'))) > 0 as field_check from n",
        "P12_retracted": "with t as (select ID, case when seq % 17 = 0 then 'RETRACTED: ' || title else title end as title, abstract from r) select ID, coalesce(starts_with(title, 'RETRACTED') or title like '%(retracted)%' or coalesce(abstract, '') like '%Withdrawn%', false) as retracted from t",
        "P13_change_entrytype": f"select ID, 'article' as ENTRYTYPE, case when ENTRYTYPE = 'article' then journal else coalesce({journal}, 'UNKNOWN') end as journal, case when ENTRYTYPE = 'article' then booktitle end as booktitle, case when ENTRYTYPE = 'article' then volume else coalesce({unk('volume')}, 'UNKNOWN') end as volume, case when ENTRYTYPE = 'article' then '' else {missing} end as missing_fields from r",
        "P31_worklist": f"with {prov} select ID, field, note from p where note <> '' and note <> 'IGNORE:missing'",
        "P33_path_parts": f"select ID, nullif(regexp_extract({folder}, '(?:^|/)([1-2][0-9]{{3}})(?:/|$)', 1), '') as year, nullif(regexp_extract({folder}, '(?:^|/)([0-9]{{1,3}})(?:_[0-9]{{1,2}})?(?:/|$)', 1), '') as volume, nullif(regexp_extract({folder}, '(?:^|/)[0-9]{{1,3}}_([0-9]{{1,2}})(?:/|$)', 1), '') as number from r where file is not null",
        "S8_repair_ids": f"with b as (select ID, 'key_' || cast(seq // 4 as string) || '_x' as base, row_number() over (partition by seq // 4 order by seq) as n from r) select ID, base || {suffix} as local_id from b",
        "S9_inheritance": "with k as (select *, case when seq % 10 <> 0 then 'R' || lpad(cast(seq // 10 * 10 as string), 7, '0') end as cr from r) select k.ID, coalesce(k.booktitle, p.booktitle) as booktitle, coalesce(k.publisher, p.publisher) as publisher, coalesce(k.year, p.year) as year from k left join r p on p.ID = k.cr where k.ID not in (select cr from k where cr is not null)",
        "S17_entrytype_clamp": "select case when seq % 3 = 1 then 'misc' else ENTRYTYPE end as ENTRYTYPE, count(*) as n from r group by 1",
        "F10_comma_names": f"select ID, array_to_string(list_transform({flip}, lambda n: {back}), ' and ') as author from r where author like '% and % and %'",
        "F14_particles": f"select ID, array_to_string(list_transform(string_split(author, ' and '), lambda n: case {part} else n end), ' and ') as author from r",
        "F23_unknown_source": f"select ID, {etype} as ENTRYTYPE, case when length(journal) > 10 and {UPPER_SQL.format('journal')} >= 0.6 then {title_case} else journal end as journal, replace(volume, 'Volume ', '') as volume from r",
        "J10_same_issue_key": f"with k as materialized (select ID, status, {KEY_SQL} as key, {TOC_SQL} as toc from r) select a.ID as a_ID, b.ID as b_ID from k a join k b on a.key = b.key and a.toc = b.toc where a.status in ('md_imported', 'md_prepared') and b.status not in ('md_imported', 'md_prepared')",
        "J13_source_rows": f"with o as (select ID, unnest(string_split(origins, ';')) as origin from r) select ID, o.origin, d.n_chars from o left join (select {src} as origin, n_chars from documents) d on d.origin = o.origin",
        "J15_merge_candidates": f"with k as materialized (select ID, {TOC_SQL} as toc, lower(title) as t from r where title is not null), s as (select a.ID as a_ID, b.ID as b_ID, round({ratio('a.t', 'b.t')}, 4) as sim from k a join k b on a.toc = b.toc and a.ID < b.ID) select * from s where sim > 95",
        "J23_files_by_hash": "with f as (select sha256(text) as h, min(file) as path from r where file is not null group by 1) select ID, f.path as found from r left join f on f.h = sha256(r.text) where file is null",
        "J24_enrichment": f"""with k as materialized (select ID, processed, {DOI_SQL} as doi, title, volume, year from r), m0 as (select doi, (min(struct_pack(a := title is not null, t := title, b := volume is not null, v := volume, c := year is not null, y := year))) as f from k where processed and doi is not null group by doi), m as materialized (select doi, f.t as title, f.v as volume, f.y as year from m0),
            j as (select k.*, m.doi as md, m.volume as mv, m.year as my, coalesce({ratio('lower(k.title)', 'lower(m.title)')} >= 50, false) as ok from k left join m on m.doi = k.doi where not processed),
            w as (select ID, unnest({words('title')}) as x, len({words('title')}) as n from j where not ok and (doi is null or md is not null) and length(title) >= 5 and title <> 'UNKNOWN'), mw as (select doi, unnest({words('title')}) as x, len({words('title')}) as n from m),
            p as (select ID, mw.doi as doi from w join mw using (x) group by ID, mw.doi having count(*) / (any_value(w.n) + any_value(mw.n) - count(*)) >= 0.7 - 1e-12),
            t as (select p.ID, m.*, {ratio('lower(j.title)', 'lower(m.title)')} as s from p join j using (ID) join m on m.doi = p.doi), b as (select *, row_number() over (partition by ID order by s desc, doi) as place from t where s >= 50)
            select j.ID, case when ok then j.doi when b.ID is not null then b.doi when md is not null then null else j.doi end as doi, {filled('volume', 'mv')}, {filled('year', 'my')}, case when ok then 'doi' when b.ID is not null then 'title' end as via
            from j left join b on b.ID = j.ID and b.place = 1""",
    }.items()}

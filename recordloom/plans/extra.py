"""Smaller operators (P3, P15, P32, P37, J8, J9, D3, Q29, W2, W8, F11, F17, F19, F24, F31, F32, T3, K6, S6, S13, S14, S21), with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions.names import parse_names_udf
from recordloom.functions.similarity import partial_ratio_udf, ratio_udf
from recordloom.operators import dedupe as D
from recordloom.operators import fulltext as X
from recordloom.operators import history as H
from recordloom.operators import lookup as L
from recordloom.operators import prep as P
from recordloom.operators import provenance as V
from recordloom.operators import transfer as O
from recordloom.plans.fixtures import records, with_records
from recordloom.plans.scalars import LCS_SQL, PAGES_SQL, TOC_SQL, _expected_sql
from recordloom.schema import POST
from recordloom.session import shared_dir
from recordloom.sources import formats
from recordloom.sources.workbooks import read_workbooks, workbooks

c = F.col


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of another project that meet a condition given as text, once for all of them."""
    return L.foreign_selection(records(spark, sf_dir), "ENTRYTYPE = 'article' and volume in ('1', '2')").select("ID")


def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated records have one provenance entry, the curation."""
    r = records(spark, sf_dir).withColumn("prov", V.parse_cell(F.concat(F.lit("title:src/"), c("seq").cast("string"), F.lit(";missing; year:manual;;"))))
    out = r.withColumn("prov", O.curate_provenance(c("prov"), c("curated").isNotNull(), "https://curation"))
    return out.select("ID", F.explode("prov").alias("field", "p")).select("ID", "field", "p.source", "p.note")


def p32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worklist of all unprocessed records edited by hand: forthcoming years are set, volumes of what isn't an article are cleared."""
    r = records(spark, sf_dir).select("ID", "ENTRYTYPE", "processed", "year", "volume")
    edits = r.filter("not processed").select("ID", F.when(c("year") == "forthcoming", "2015").otherwise(c("year")).alias("year"), F.when(c("ENTRYTYPE") == "article", c("volume")).alias("volume"))
    return O.import_edits(r, edits, ["year", "volume"]).select("ID", "year", "volume", F.try_element_at("notes", F.lit("volume")).alias("volume_note"), F.try_element_at("notes", F.lit("year")).alias("year_note"))


def p37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records handed to a project that has the processed ones: new ones get the next ids there."""
    r = records(spark, sf_dir)
    there = r.filter("processed").select(c("ID").alias("origin"), F.lpad((c("seq") + 1).cast("string"), 6, "0").alias("id"))
    return O.distribute(there, r)


def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an issue by authors and title, at 70 of 100 or more."""
    return D.issue_pairs(records(spark, sf_dir)).select("a_ID", "b_ID", "sim")


def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most similar records of each record's issue."""
    return D.ranked_candidates(records(spark, sf_dir))


def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a record changed against an edited one."""
    r = records(spark, sf_dir).select("ID", F.lower("title").alias("a"), F.lower(F.concat(F.lit("the "), F.substring("title", 3, 1 << 30))).alias("b"))
    return r.filter("a is not null").select("ID", F.round(1 - ratio_udf("a", "b") / 100, 6).alias("change_score"))


def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose number of pages isn't what the record's pages say; a text's page has 3,000 characters."""
    r = records(spark, sf_dir).filter("file is not null").withColumn("found", F.ceil(F.char_length("text") / 3000).cast("int"))
    return X.incomplete_files(r, "found")


def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose id may be set anew."""
    return records(spark, sf_dir).filter(c("status").isin("md_imported", "md_prepared") & ~c("status").isin(POST["md_processed"])).select("ID")


def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by their number of origins."""
    return O.change_order(records(spark, sf_dir), F.size(F.split("origins", ";")))


def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("author is not null").select("ID", F.posexplode(parse_names_udf("author")).alias("pos", "n")).select("ID", "pos", "n.*")


def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose source names the number issue: it is taken where there is no number."""
    return O.rename_where_absent(records(spark, sf_dir).withColumn("issue", c("volume")), {"issue": "number"}).select("ID", "number")


def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags, the common entities read."""
    v = F.regexp_replace("html", "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(v.cast("binary")).alias("text_md5"))


def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", F.lower("title").alias("t"), F.lower("abstract").alias("u"), F.lower("journal").alias("j"))


def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("ID", F.round(partial_ratio_udf("t", "u"), 6).alias("ratio"))


def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of a query's title and container with a found one's, 0 to 100."""
    return _titles(spark, sf_dir).filter("j is not null").select("ID", F.round(0.6 * partial_ratio_udf("t", "u") + 0.4 * partial_ratio_udf("j", F.lit("journal of things")), 6).alias("similarity"))


def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of source rows carried to the records that come from them: unknown fields are filled, curated records stay."""
    r = records(spark, sf_dir)
    feed = r.filter("seq % 2 = 0").select(F.split("origins", ";")[0].alias("origin"), F.lit("2023").alias("f_year"), F.lit("5").alias("f_volume"))
    j = r.withColumn("origin", F.split("origins", ";")[0]).join(feed, "origin", "left")
    fill = lambda f: F.when(c("curated").isNull() & (c(f).isNull() | c(f).isin("", "UNKNOWN", "forthcoming")), F.coalesce(c(f"f_{f}"), c(f))).otherwise(c(f)).alias(f)
    return j.select("ID", fill("year"), fill("volume"))


def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included records as a bibliography."""
    return O.bibliography(records(spark, sf_dir), "bib", ["author", "title", "year"])


def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields only: the scan reads no others."""
    return records(spark, sf_dir).select("ID", "origins", "status")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV written and read again."""
    path = _folder(spark, "csv")
    records(spark, sf_dir).select(c("ID").alias("Record ID"), c("title").alias("Title"), c("year").alias("Publication Year")).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return formats.read_csv(spark, path, {"Record ID": "ID", "Publication Year": "year"}, keep_empty=True)


def s13_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as workbooks, read again."""
    books = workbooks(records(spark, sf_dir).select(c("ID").alias("Record ID"), c("title").alias("Title"), c("year").alias("Publication Year")), ["Record ID", "Title", "Publication Year"], order="Record ID")
    cell = lambda n: F.try_element_at("cells", F.lit(n))
    return read_workbooks(books).select(cell("Record ID").alias("ID"), cell("Title").alias("title"), cell("Publication Year").alias("year"))


def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    records(spark, sf_dir).select("ID", "title", c("seq").alias("number")).write.json(path)
    return spark.read.json(path, primitivesAsString=True).select("ID", "title", "number")


def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    fields = F.create_map(F.when(c("seq") % 5 == 0, "Bad Key").otherwise("title"), F.coalesce("title", F.lit("")), F.when(c("seq") % 7 == 0, "md_provenance").otherwise("year"), F.lit("x"))
    return P.import_violations(r.select(F.when(c("seq") % 11 != 0, c("ID")).alias("local_id"), F.when(c("seq") % 13 != 0, c("ENTRYTYPE")).alias("ENTRYTYPE"), fields.alias("fields"))).groupBy("problem").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "P3_foreign_predicate": p3, "P15_curated": p15, "P32_manual_import": p32, "P37_distribute": p37, "J8_issue_pairs": j8, "J9_ranked_candidates": j9, "D3_change_score": d3, "Q29_pdf_incomplete": q29, "W2_eligible_ids": w2,
        "W8_origin_order": w8, "F11_bibtex_names": f11, "F17_issue_number": f17, "F19_strip_tags": f19, "F24_nested_values": f24, "F31_partial_ratio": f31, "F32_query_similarity": f32, "T3_propagate": t3, "K6_bibliography": k6,
        "S6_header_scan": s6, "S13_csv_round_trip": s13, "S13_workbooks": s13_workbooks, "S14_json_round_trip": s14, "S21_import_violations": s21,
    }


def oracle_sql() -> dict[str, str]:
    ratio = lambda a, b: f"(case when {a} = '' and {b} = '' then 100.0 when {a} = '' or {b} = '' then 0.0 else 200.0 * {LCS_SQL.format(a=a, b=b)} / (length({a}) + length({b})) end)"
    pairs = f"k as materialized (select ID, {TOC_SQL} as toc, lower(title) as t, lower(author) as a from r where title is not null and author is not null), s as (select a.ID as a_ID, b.ID as b_ID, round(0.4 * {ratio('a.a', 'b.a')} + 0.6 * {ratio('a.t', 'b.t')}, 4) as sim from k a join k b on a.toc = b.toc and a.ID <> b.ID)"
    bib = "'@' || ENTRYTYPE || '{' || ID || ',' || chr(10) || array_to_string(list_filter([" + ", ".join(f"case when {f} is not null and {f} <> '' then '   {f.ljust(28)} = {{' || {f} || '}}' end" for f in ("author", "title", "year")) + "], lambda x: x is not null), ',' || chr(10)) || ',' || chr(10) || '}' || chr(10)"
    fill = lambda f, v: f"case when curated is null and seq % 2 = 0 and ({f} is null or {f} in ('', 'UNKNOWN', 'forthcoming')) then '{v}' else {f} end as {f}"
    expected = _expected_sql().replace("pages", f"({PAGES_SQL})")
    return {k: with_records(v) for k, v in {
        "P3_foreign_predicate": "select ID from r where ENTRYTYPE = 'article' and volume in ('1', '2')",
        "P15_curated": "select ID, 'CURATED' as field, 'https://curation' as source, '' as note from r where curated is not null union all select ID, 'title', 'src/' || cast(seq as string), 'missing' from r where curated is null union all select ID, 'year', 'manual', '' from r where curated is null",
        "P32_manual_import": "select ID, case when not processed and year = 'forthcoming' then '2015' else year end as year, case when processed or ENTRYTYPE = 'article' then volume when volume = 'UNKNOWN' then null end as volume, case when not processed and ENTRYTYPE <> 'article' and volume is not null then 'IGNORE:missing' end as volume_note, cast(null as varchar) as year_note from r",
        "P37_distribute": "with t as (select ID as origin, lpad(cast(seq + 1 as string), 6, '0') as id from r where processed) select * from t union all select ID, lpad(cast((select max(cast(id as bigint)) from t) + row_number() over (order by ID) as string), 6, '0') from r where not processed",
        "J8_issue_pairs": f"with {pairs} select a_ID, b_ID, sim from s where a_ID < b_ID and sim >= 70",
        "J9_ranked_candidates": f"with {pairs}, x as (select *, row_number() over (partition by a_ID order by sim desc, b_ID) as place from s) select a_ID, b_ID, sim, cast(place as integer) as place, sim > 80 as likely from x where place <= 20",
        "D3_change_score": f"with k as (select ID, lower(title) as a, lower('the ' || substr(title, 3)) as b from r where title is not null) select ID, round(1 - {ratio('a', 'b')} / 100, 6) as change_score from k",
        "Q29_pdf_incomplete": f"with k as (select ID, {expected} as expected, cast(ceil(length(text) / 3000) as integer) as found from r where file is not null and pages is not null) select ID, cast(expected as integer) as expected, found from k where expected <> found",
        "W2_eligible_ids": "select ID from r where status in ('md_imported', 'md_prepared')",
        "W8_origin_order": "with k as (select ID, array_to_string(list_sort(string_split(origins, ';')), ';') as origins, cast(len(string_split(origins, ';')) as integer) as score from r) select *, row_number() over (order by score desc, ID) as place from k",
        "F17_issue_number": "select ID, coalesce(nullif(number, ''), volume) as number from r",
        "T3_propagate": f"select ID, {fill('year', '2023')}, {fill('volume', '5')} from r",
        "K6_bibliography": f"select ID, {bib} as text from r where status in ('rev_included', 'rev_synthesized')",
        "S6_header_scan": "select ID, origins, status from r",
        "S13_csv_round_trip": "select ID, title, year from r",
        "S13_workbooks": "select ID, nullif(title, '') as title, nullif(year, '') as year from r",
        "S14_json_round_trip": "select ID, title, cast(seq as string) as number from r",
        "S21_import_violations": "with v as (select unnest(list_filter([case when seq % 11 = 0 then 'no ID' end, case when seq % 13 = 0 then 'no ENTRYTYPE' end, case when seq % 5 = 0 then 'field name' end, case when title is null or title = '' then 'empty value' end, case when seq % 7 = 0 then 'provenance field' end], lambda x: x is not null)) as problem from r) select problem, count(*) as n from v group by 1",
    }.items()} | {
        "F19_strip_tags": "select page_id, md5(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) as text_md5 from pages",
        "F24_nested_values": "select event_id, json_extract_string(props, '$.k') as k from events",
    }

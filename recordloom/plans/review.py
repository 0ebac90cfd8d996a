"""Prescreen and screen queries (P*), with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import review as R
from recordloom.plans.fixtures import records, with_records

SCOPE = R.Scope(
    entrytypes=["article", "inproceedings", "misc"], exclude_outlets=[{"journal": "Journal of src1"}, {"journal": "MISQ"}], time_from=1995, time_to=2020,
    exclude_complementary=True, languages=["eng", "deu", "fra"],
)


def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that wait for preparation or are books."""
    return R.matching(records(spark, sf_dir), [{"status": "md_imported"}, {"ENTRYTYPE": "book", "language": "eng"}]).select("ID", "status", "ENTRYTYPE")


def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate given as SQL text."""
    return records(spark, sf_dir).where("title ilike '%the%' and year between '2000' and '2010'").select("ID")


def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclude(records(spark, sf_dir), F.col("title").contains("UNKNOWN") | (F.col("year") == "UNKNOWN"), "incomplete").select("ID", "status", "prescreen_exclusion", "title", "year", "volume")


def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return R.select_ids(r, r.filter("seq % 3 = 0").select("ID"), include=True).select("ID", "status")


def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scope_prescreen(records(spark, sf_dir), SCOPE).select("ID", "status", "prescreen_exclusion")


def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scope_prescreen(records(spark, sf_dir), R.Scope()).select("ID", "status")


def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclude(records(spark, sf_dir), R.is_complementary(), "complementary material").select("ID", "status", "prescreen_exclusion")


def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclude(records(spark, sf_dir), F.col("ENTRYTYPE") == "proceedings", "collection").groupBy("status").agg(F.count("*").alias("n"))


def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of a wrong form are dropped."""
    from recordloom.operators.quality import ISBN

    keep = lambda f, pattern: F.when(F.col(f).rlike(pattern), F.col(f)).alias(f)
    return records(spark, sf_dir).select("ID", keep("doi", "^10.[0-9]{4,9}/"), keep("isbn", ISBN))


def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter(F.coalesce("year", F.lit("")) != "forthcoming").groupBy("year").agg(F.count("*").alias("n"))


def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.screen(records(spark, sf_dir), F.col("seq") % 3 != 0, ["c1", "c2"]).select("ID", "status", "screening_criteria")


def p28_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.add_criterion(records(spark, sf_dir), "c3", ["c1", "c2", "c3"]).select("ID", "status", "screening_criteria")


def p28_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delete_criterion(records(spark, sf_dir), "c1").select("ID", "status", "screening_criteria")


def p29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.criteria_violations(records(spark, sf_dir), ["c1", "c2"])


def p30(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return R.remove_records(r, r.filter("seq % 5 = 0").select("ID")).select("ID", F.explode(F.split("origins", ";")).alias("origin"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "P1_matching_records": p1, "P2_sql_predicate": p2, "P11_prescreen_exclude": p11, "P18_select_ids": p18, "P19_scope_prescreen": p19, "P20_conditional_prescreen": p20,
        "P22_complementary_material": p22, "P24_collections": p24, "P25_remove_broken_ids": p25, "P26_forthcoming": p26, "P27_screen": p27, "P28_add_criterion": p28_add,
        "P28_delete_criterion": p28_delete, "P29_criteria_violations": p29, "P30_remove_records": p30,
    }


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def oracle_sql() -> dict[str, str]:
    from recordloom.operators.quality import ISBN

    s = SCOPE
    reason = f"""case when language not in {_list(s.languages)} then 'not in language scope'
        when lower(title) in {_list(R.COMPLEMENTARY_PARTS + R.COMPLEMENTARY_TITLES)} then 'complementary material'
        when (case when year is null then 5000 else try_cast(year as integer) end) > {s.time_to} then 'not in TimeScopeTo (<{s.time_to})'
        when (case when year is null then 0 else try_cast(year as integer) end) < {s.time_from} then 'not in TimeScopeFrom (>{s.time_from})'
        when journal in ('Journal of src1', 'MISQ') then 'in OutletExclusionScope' when ENTRYTYPE not in {_list(s.entrytypes)} then 'not in ENTRYTYPEScope' end"""
    t = "trim(lower(title))"
    compl = "coalesce(" + " or ".join(f"{t} like '%{x}%'" for x in R.COMPLEMENTARY_PARTS) + f" or {t} in {_list(R.COMPLEMENTARY_TITLES)} or " + " or ".join(f"{t} like '{x}%'" for x in R.COMPLEMENTARY_STARTS) + ", false)"
    unknown = "coalesce(title like '%UNKNOWN%', false) or coalesce(year = 'UNKNOWN', false)"
    screened = "status in ('rev_included', 'rev_excluded', 'rev_synthesized')"
    left = "array_to_string(list_filter(string_split(screening_criteria, ';'), lambda x: split_part(x, '=', 1) <> 'c1'), ';')"
    return {k: with_records(v) for k, v in {
        "P1_matching_records": "select ID, status, ENTRYTYPE from r where status = 'md_imported' or (ENTRYTYPE = 'book' and language = 'eng')",
        "P2_sql_predicate": "select ID from r where title ilike '%the%' and year between '2000' and '2010'",
        "P11_prescreen_exclude": f"select ID, case when {unknown} then 'rev_prescreen_excluded' else status end as status, case when {unknown} then 'incomplete' end as prescreen_exclusion, "
        + ", ".join(f"case when ({unknown}) and {f} = 'UNKNOWN' then null else {f} end as {f}" for f in ("title", "year", "volume")) + " from r",
        "P18_select_ids": "select ID, case when seq % 3 = 0 and status = 'md_processed' then 'rev_prescreen_included' else status end as status from r",
        "P19_scope_prescreen": f"select ID, case when why is not null then 'rev_prescreen_excluded' when status = 'md_processed' then 'rev_prescreen_included' else status end as status, why as prescreen_exclusion from (select *, case when status = 'md_processed' then {reason} end as why from r)",
        "P20_conditional_prescreen": "select ID, case when status = 'md_processed' then 'rev_prescreen_included' else status end as status from r",
        "P22_complementary_material": f"select ID, case when {compl} then 'rev_prescreen_excluded' else status end as status, case when {compl} then 'complementary material' end as prescreen_exclusion from r",
        "P24_collections": "select case when ENTRYTYPE = 'proceedings' then 'rev_prescreen_excluded' else status end as status, count(*) as n from r group by 1",
        "P25_remove_broken_ids": f"select ID, case when regexp_matches(doi, '^10.[0-9]{{4,9}}/') then doi end as doi, case when regexp_matches(isbn, '{ISBN}') then isbn end as isbn from r",
        "P26_forthcoming": "select year, count(*) as n from r where coalesce(year, '') <> 'forthcoming' group by year",
        "P27_screen": "select ID, case when status = 'pdf_prepared' then case when seq % 3 <> 0 then 'rev_included' else 'rev_excluded' end else status end as status, case when status = 'pdf_prepared' and seq % 3 <> 0 then 'c1=in;c2=in' else screening_criteria end as screening_criteria from r",
        "P28_add_criterion": f"select ID, case when ({screened} and screening_criteria is null) or status in ('rev_included', 'rev_synthesized') then 'pdf_prepared' else status end as status, case when {screened} and screening_criteria is null then 'c1=TODO;c2=TODO;c3=TODO' when {screened} then screening_criteria || ';c3=TODO' else screening_criteria end as screening_criteria from r",
        "P28_delete_criterion": f"select ID, case when status = 'rev_excluded' and not regexp_matches({left}, '=(out|TODO)') then 'rev_included' else status end as status, case when {screened} then {left} else screening_criteria end as screening_criteria from r",
        "P29_criteria_violations": """select * from (select ID, status, screening_criteria, case
            when status in ('rev_included', 'rev_synthesized') and not regexp_matches(coalesce(screening_criteria, ''), '^c1=(in);c2=(in)$') then 'included record does not meet all criteria'
            when status = 'rev_excluded' and (not regexp_matches(coalesce(screening_criteria, ''), '^c1=(in|out);c2=(in|out)$') or coalesce(screening_criteria, '') not like '%=out%') then 'excluded record without a reason'
            when status not in ('pdf_prepared', 'rev_excluded', 'rev_included', 'rev_synthesized') and coalesce(screening_criteria, '') <> '' then 'criteria before the screen' end as problem from r) where problem is not null""",
        "P30_remove_records": "select ID, unnest(string_split(origins, ';')) as origin from r where seq % 5 <> 0",
    }.items()}

"""Quality queries (Q*, P9, P10, F3 and status A1-A7) over the records, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import quality, status
from recordloom.plans.fixtures import records, with_records
from recordloom.schema import FORBIDDEN, POST, REQUIRED, STATES


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _known(f: str) -> str:
    return f"({f} is not null and {f} <> 'UNKNOWN')"


def _count(text: str, keep: str) -> str:
    return f"length(regexp_replace({text}, '[^{keep}]', '', 'g'))"


def _upper(text: str) -> str:
    letters = f"regexp_replace({text}, '[^a-zA-Z]', '', 'g')"
    return f"(case when length({letters}) > 0 then length(regexp_replace({letters}, '[^A-Z]', '', 'g')) / length({letters}) else 0 end)"


def _bare(f: str) -> str:
    return f"replace(lower({f}), 'the ', '')"


_NAMES = "string_split(author, ' and ')"
_WORD = r"\p{L}\p{N}_"


def _caps(f: str) -> str:
    base = f"{_known(f)} and {_upper(f'replace({f}, chr(32) || chr(97) || chr(110) || chr(100) || chr(32), chr(32)[1:0])')} >= 0.7 and upper({f}) <> 'PLOS ONE'"
    if f in ("journal", "booktitle"):
        return base + f" and length({f}) >= 6"
    return base + f" and not (ENTRYTYPE = 'online' and length({f}) < 10)" if f == "title" else base


def _sql_checks() -> dict[int, dict[str, str]]:
    out: dict[int, dict[str, str]] = {1: {}, 3: {}}
    for f in ("author", "title", "year", "journal", "booktitle", "volume", "number", "publisher", "school", "url"):
        out[1][f] = f"ENTRYTYPE in {_in([t for t, x in REQUIRED.items() if f in x])} and not {_known(f)}" + (" and coalesce(year, '') <> 'forthcoming'" if f in ("volume", "number") else "")
    cut = lambda f: f"({f} like '%...' or {f} like '%…')"
    out[2] = {f: f"{_known(f)} and {cut(f)}" for f in ("title", "journal", "booktitle", "abstract")}
    out[2]["author"] = f"{_known('author')} and not (author like '{{%' and author like '%}}') and ({cut('author')} or author like '%, and %' or rtrim(author) like '%,' or author not like '%,%')"
    for f in dict.fromkeys(x for fields in FORBIDDEN.values() for x in fields if x != "issue"):
        out[3][f] = f"{f} is not null and ENTRYTYPE in {_in([t for t, x in FORBIDDEN.items() if f in x])}"
    out[4] = {"journal": "lower(journal) like '%conference%' or lower(journal) like '%workshop%'", "booktitle": "lower(booktitle) like '%journal%'"}
    short = lambda f: f"(length({f}) < 6 and upper({f}) = {f})"
    out[5] = {"journal": f"{_known('journal')} and {short('journal')}", "booktitle": f"{_known('booktitle')} and ({short('booktitle')} or booktitle like '%Proc.%')"}
    out[6] = {f: f"{_known('title')} and {_known(f)} and {_bare('title')} = {_bare(f)}" for f in ("journal", "booktitle")}
    out[7] = {f: _caps(f) for f in ("title", "author", "journal", "booktitle")}
    out[8] = {"doi": "not regexp_matches(doi, '^10.[0-9]{4,9}/')"}
    out[10] = {"isbn": f"not regexp_matches(isbn, '{quality.ISBN}')"}
    out[11] = {"pubmedid": r"not regexp_matches(pubmedid, '^[0-9]{1,8}(\.[0-9])?$')"}
    out[13] = {"language": "length(language) <> 3"}
    out[14] = {"title": f"{_known('title')} and language is null"}
    out[15] = {"year": f"{_known('year')} and not regexp_matches(year, '^[0-9]{{4}}$')"}
    out[16] = {"pages": "regexp_matches(pages, '^[0-9]+--[0-9]+$') and try_cast(split_part(pages, '--', 1) as bigint) > try_cast(split_part(pages, '--', 2) as bigint)"}
    out[17] = {f: f"regexp_matches({f}, '[�™]')" for f in ("author", "title", "journal", "booktitle", "abstract")}
    out[18] = {f: " or ".join(f"lower({f}) like '%{t}%'" for t in terms) for f, terms in quality.ERRONEOUS_TERMS.items()}
    digits = f"{_count('title', '0-9')} > {_count('title', chr(92) + 'p{L}')}"
    out[19] = {"title": f"{_known('title')} and (title in {_in(quality.BROKEN_TITLES)} or {digits} or (title not like '% %' and regexp_matches(title, '[_.0-9]')))"}
    clean = rf"replace(replace(regexp_replace(author, '[{{}}]|\([{_WORD}]*\)|\"[{_WORD}]*\"', '', 'g'), ' and others', ''), ' et al.', '')".replace('\\"', '"')
    shaped = f"len(list_filter(string_split({clean}, ' and '), lambda n: not regexp_matches(n, '^[{_WORD} .‐''’-]*, [{_WORD} .‐''’-]*$'))) = 0"
    upper = f"len(list_filter(string_split({clean}, ' and '), lambda n: len(list_filter(string_split(n, ','), lambda p: not regexp_matches(p, '\\p{{Lu}}'))) > 0)) = 0"
    out[20] = {"author": f"{_known('author')} and (author not like '%,%' or not ({shaped}) or not ({upper}))"}
    out[21] = {"author": "regexp_matches(lower(' ' || regexp_replace(author, '[,.]', ' ', 'g') || ' '), ' (dr|phd|prof) ')"}
    out[22] = {"author": "regexp_matches(regexp_replace(author, '[ .]+$', ''), '(and others|et al)$')"}
    out[23] = {"author": f"len(list_filter({_NAMES}, lambda n: n like '% vom' or n like 'vom %' or n like '% von' or n like 'von %')) > 0"}
    out[24] = {f: f"regexp_matches({f}, '&#[0-9]+;')" for f in ("author", "title", "journal", "booktitle", "abstract", "keywords")}
    out[25] = {"author": "ENTRYTYPE in ('thesis', 'phdthesis', 'mastersthesis') and author like '% and %'"}
    return out


def _defects_sql(only: list[int]) -> str:
    sql = _sql_checks()
    codes = quality.CODES
    return " union all ".join(f"select ID, '{f}' as field, '{codes[n]}' as code from r where curated is null and ({cond})" for n in only for f, cond in sql[n].items())


FATAL = (
    f"(not {_known('title')} or not {_known('author')} or not {_known('year')} or (not {_known('journal')} and not {_known('booktitle')} and ENTRYTYPE in ('article', 'inproceedings'))"
    f" or coalesce({_bare('title')} = {_bare('journal')}, false) or coalesce({_bare('title')} = {_bare('booktitle')}, false)"
    f" or lower(coalesce(title, '')) like 'doi:%' or {_count('coalesce(title, chr(32)[1:0])', '0-9')} > {_count('coalesce(title, chr(32)[1:0])', chr(92) + 'p{L}')})"
)


def _defects(spark: SparkSession, sf_dir: str, only: list[int]) -> DataFrame:
    return quality.defect_rows(records(spark, sf_dir), only)


def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks at once: defects by field and code."""
    return quality.defect_rows(records(spark, sf_dir)).groupBy("field", "code").agg(F.count("*").alias("n"))


def fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", quality.fatal_defects().alias("fatal"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("status = 'md_imported'").select("ID", quality.set_prepared().alias("status"))


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by state: now there, and having passed the state."""
    return status.report(records(spark, sf_dir))


def origins_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.origin_statistics(records(spark, sf_dir))


def origin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.origin_states(records(spark, sf_dir)).groupBy("source", "status").agg(F.count("*").alias("n"))


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.screening_statistics(records(spark, sf_dir))


def atomic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.atomic_steps(records(spark, sf_dir))


def curated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.curated_percentage(records(spark, sf_dir))


def active_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.active_operations(records(spark, sf_dir))


def preceding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.preceding_states(spark)


_STATES_SQL = "(values " + ", ".join(f"('{s}', {i + 1})" for i, s in enumerate(STATES)) + ") s(state, state_rank)"
_TRANS_SQL = "(values " + ", ".join(f"('{o}', '{a}', '{b}')" for o, a, b in status.TRANSITIONS) + ") t(operation, source, dest)"
_POST_SQL = "(values " + ", ".join(f"('{x}', '{s}')" for x, members in POST.items() for s in members) + ") p(passed, status)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"status_report": status_report, "Q0_quality_model": quality_model}
    for n, code in quality.CODES.items():
        out[f"Q{n}_{code.replace('-', '_')}"] = partial(_defects, only=[n])
    return out | {
        "P9_fatal_defects": fatal, "P10_set_prepared": prepared, "A3_origin_statistics": origins_stats, "A4_origin_states": origin_states, "A5_screening_statistics": screening,
        "A6_atomic_steps": atomic_steps, "A7_curated_percentage": curated_share, "A8_active_operations": active_operations, "W14_preceding_states": preceding_states,
    }


def oracle_sql() -> dict[str, str]:
    every = list(quality.CODES)
    out = {"Q0_quality_model": with_records(f"select field, code, count(*) as n from ({_defects_sql(every)}) group by field, code")}
    for n, code in quality.CODES.items():
        out[f"Q{n}_{code.replace('-', '_')}"] = with_records(_defects_sql([n]))
    weights = "(values " + ", ".join(f"('{s}', {w})" for s, w in status.STEPS_DONE.items()) + ") w(status, steps)"
    return out | {
        "status_report": with_records(f"""
            select s.state, s.state_rank, (select count(*) from r where r.status = s.state) as currently,
              (select count(*) from r join {_POST_SQL} on p.status = r.status where p.passed = s.state) as overall from {_STATES_SQL}"""),
        "P9_fatal_defects": with_records(f"select ID, {FATAL} as fatal from r"),
        "P10_set_prepared": with_records(f"select ID, case when {FATAL} then 'md_needs_manual_preparation' else 'md_prepared' end as status from r where status = 'md_imported'"),
        "A3_origin_statistics": with_records("""
            select cast(sum(n) as bigint) as origins, cast(sum(greatest(n - 1, 0)) as bigint) as duplicates_removed
            from (select len(list_filter(string_split(origins, ';'), lambda o: not starts_with(o, 'md_'))) as n from r)"""),
        "A4_origin_states": with_records("select split_part(o, '/', 1) as source, status, count(*) as n from (select unnest(string_split(origins, ';')) as o, status from r) group by 1, 2"),
        "A5_screening_statistics": with_records("""
            select split_part(x, '=', 1) as criterion, count(*) filter (split_part(x, '=', 2) = 'out') as excluded, count(*) as screened
            from (select unnest(string_split(screening_criteria, ';')) as x from r where screening_criteria is not null) group by 1"""),
        "A6_atomic_steps": with_records(f"select cast(9 * count(*) as bigint) as atomic_steps, cast(sum(steps) as bigint) as completed from r join {weights} on r.status = w.status"),
        "A7_curated_percentage": with_records("select cast(floor(100.0 * count(curated) / greatest(count(*), 1)) as integer) as perc_curated from r"),
        "A8_active_operations": with_records(f"select distinct operation from r join {_TRANS_SQL} on t.source = r.status"),
        "W14_preceding_states": f"""
            with recursive c(state, before) as (select dest, source from {_TRANS_SQL} union select c.state, t.source from c join {_TRANS_SQL} on t.dest = c.before)
            select state, before from c""",
    }

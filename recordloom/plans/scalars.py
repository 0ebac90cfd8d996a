"""Scalar functions (F*) applied to records, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions.similarity import ratio_udf
from recordloom.plans.fixtures import records, with_records

c = F.col


def citation_key() -> Column:
    """Last names and year; more than three authors are the first and EtAl."""
    clean = lambda n: F.regexp_replace(T.remove_accents(n), "[^0-9a-zA-Z]", "")
    name = lambda n: F.when(F.upper(clean(n)) == clean(n), F.initcap(clean(n))).otherwise(clean(n))
    names = F.transform(T.last_names(c("author")), name)
    people = F.when(F.size(names) > 3, F.concat(names[0], F.lit("EtAl"))).otherwise(F.array_join(names, ""))
    return F.concat(people, F.coalesce("year", F.lit("")))


def alphabet_language(col: Column, share: float = 0.75) -> Column:
    """Language of a text mostly in one alphabet of its own."""
    part = lambda chars: F.char_length(F.regexp_replace(col, f"[^{chars}]", "")) / F.greatest(F.char_length(col), F.lit(1))
    out = None
    for lang, chars in ALPHABETS.items():
        out = F.when(part(chars) > share, lang) if out is None else out.when(part(chars) > share, lang)
    return out


# fixed values: alphabets of languages by their code points
ALPHABETS = {"ell": "α-ωΑ-Ω", "rus": "а-яА-Я", "heb": "א-ת", "ara": "ء-ي", "kor": "가-힣", "chi": "一-鿿"}
LANGUAGES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "english": "eng"}
# fixed values: acronyms written in capitals
ACRONYMS = ["IT", "IS", "ERP", "CRM", "AIS", "MIS"]


def unify_language(col: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.char_length(col) == 3, col).otherwise(table[F.lower(col)])


def clean_booktitle(col: Column) -> Column:
    v = T.polish_mostly_upper(col)
    for pattern in ("[0-9]{4}", "[0-9]{1,2}(th|nd|rd|st)", r"\([A-Z]{3,6}\)"):
        v = F.regexp_replace(v, pattern, "")
    return F.trim(F.replace(F.replace(v, F.lit("Proceedings of the"), F.lit("")), F.lit("Proceedings"), F.lit("")))


def polish_acronyms(col: Column) -> Column:
    out = col
    for a in ACRONYMS:
        out = F.regexp_replace(out, rf"(?i)\b{a}\b", a)
    return out


def standardise(field: str) -> Column:
    v = c(field)
    if field == "title":
        return F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+", " ")), "[.]+$", "")
    if field == "year":
        return F.regexp_replace(v, "[.]0$", "")
    return F.when(F.lower(v).isin("n.pag.", "n.pag"), F.lit(None).cast("string")).otherwise(v)


_ROMAN = "list_reduce(list_transform(string_split(lower({x}), ''), lambda ch: [0, case ch when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 end]), lambda acc, d: [acc[1] + d[2] - case when acc[2] < d[2] then 2 * acc[2] else 0 end, d[2]], [0, 0])[1]"


def _slug_sql(x: str) -> str:
    for a, b in (("chr(10)", "' '"), ("'/'", "' '"), ("'–'", "' '"), ("'emph{'", "''"), ("'&amp;'", "'and'"), ("' & '", "' and '")):
        x = f"replace({x}, {a}, {b})"
    x = f"regexp_replace(translate({x}, '{T.ACCENTED}', '{T.PLAIN}'), '[^0-9a-zA-Z -]', '', 'g')"
    x = rf"lower(regexp_replace(regexp_replace({x}, '\s+', '-', 'g'), '-+', '-', 'g'))"
    return f"(case when length({x}) > 1 then regexp_replace({x}, '-+$', '') else {x} end)"


def _known_sql(f: str) -> str:
    return f"(case when {f} is not null and {f} <> 'UNKNOWN' then {f} end)"


_PART = "(case when {0} is null or {0} = 'UNKNOWN' then '-' else {0} end)"
TOC_SQL = (
    f"(case when ENTRYTYPE = 'article' then {_slug_sql(_known_sql('journal'))} || '|' || {_PART.format('volume')} || '|' || {_PART.format('number')}"
    f" when ENTRYTYPE = 'inproceedings' then {_slug_sql(_known_sql('booktitle'))} || '|' || coalesce(year, '') end)"
)
LAST_SQL = "list_transform(string_split(author, ' and '), lambda n: trim(split_part(n, ',', 1)))"
_PLACE = f"(case when ENTRYTYPE = 'article' then {_slug_sql(_known_sql('journal'))} || '|' || {_slug_sql('coalesce(volume, chr(45))')} || '|' || {_slug_sql('coalesce(number, chr(45))')} when ENTRYTYPE = 'inproceedings' then {_slug_sql(_known_sql('booktitle'))} else '-' end)"
KEY_SQL = (
    "replace('id1:' || (case ENTRYTYPE when 'article' then 'a' when 'inproceedings' then 'p' else ENTRYTYPE end) || '|' || "
    f"{_PLACE} || '|' || {_known_sql('year')} || '|' || {_slug_sql('array_to_string(' + LAST_SQL.replace('author', _known_sql('author')) + ', chr(32))')} || '|' || {_slug_sql(_known_sql('title'))}, ';', '')"
)
UPPER_SQL = "(case when length(regexp_replace({0}, '[^a-zA-Z]', '', 'g')) > 0 then length(regexp_replace({0}, '[^A-Z]', '', 'g')) / length(regexp_replace({0}, '[^a-zA-Z]', '', 'g')) else 0 end)"
_POLISH = "(case when " + UPPER_SQL + " >= 0.6 then upper(substr(lower({0}), 1, 1)) || substr(lower({0}), 2) else {0} end)"
DOI_SQL = "upper(regexp_replace(lower(doi), '^https?://(www[.]|dx[.])?doi[.]org/', ''))"
_P = "regexp_replace(replace(replace(trim(pages), ' ', ''), '–', '--'), '-+', '--', 'g')"
PAGES_SQL = (
    f"(case when regexp_matches({_P}, '^[0-9]+--[0-9]+$') and length(split_part({_P}, '--', 1)) > length(split_part({_P}, '--', 2)) then split_part({_P}, '--', 1) || '--' || "
    f"substr(split_part({_P}, '--', 1), 1, length(split_part({_P}, '--', 1)) - length(split_part({_P}, '--', 2))) || split_part({_P}, '--', 2) else {_P} end)"
)


def _latex_sql(x: str) -> str:
    for k, v in T.LATEX.items():
        for form in ("{" + k + "}", k):
            x = "replace({}, '{}', '{}')".format(x, form.replace("'", "''"), v)
    return x


def _booktitle_sql() -> str:
    v = _POLISH.format("booktitle")
    for pattern in ("[0-9]{4}", "[0-9]{1,2}(th|nd|rd|st)", r"\([A-Z]{3,6}\)"):
        v = f"regexp_replace({v}, '{pattern}', '', 'g')"
    return f"trim(replace(replace({v}, 'Proceedings of the', ''), 'Proceedings', ''))"


def _acronym_sql() -> str:
    x = "title"
    for a in ACRONYMS:
        x = rf"regexp_replace({x}, '(?i)\b{a}\b', '{a}', 'g')"
    return x


def _clean_name_sql() -> str:
    cleaned = f"regexp_replace(translate(n, '{T.ACCENTED}', '{T.PLAIN}'), '[^0-9a-zA-Z]', '', 'g')"
    return f"list_transform({LAST_SQL}, lambda n: case when upper({cleaned}) = {cleaned} then upper(substr({cleaned}, 1, 1)) || lower(substr({cleaned}, 2)) else {cleaned} end)"


def _expected_sql() -> str:
    a, b = (f"regexp_extract(pages, '^([^-]+)--?([^-]+)$', {i})" for i in (1, 2))
    num = lambda x: f"coalesce(try_cast({x} as integer), case when regexp_matches(lower({x}), '^[ivxlcdm]+$') then {_ROMAN.format(x=x)} end)"
    return f"(case when pages not like '%-%' then 1 else {num(b)} - {num(a)} + 1 end)"


_FUNCTIONS: dict[str, tuple[Callable[[], Column], str]] = {
    "F1_remove_accents": (lambda: T.remove_accents(c("author")), f"translate(author, '{T.ACCENTED}', '{T.PLAIN}')"),
    "F2_origin_prefix": (lambda: T.origin_prefix(F.split("origins", ";")[0]), "split_part(string_split(origins, ';')[1], '/', 1)"),
    "F3_percent_upper": (lambda: T.percent_upper(c("title")), UPPER_SQL.format("title")),
    "F4_record_key": (T.record_key, KEY_SQL),
    "F5_slug": (lambda: T.slug(c("title")), _slug_sql("title")),
    "F6_last_names": (lambda: F.array_join(T.last_names(c("author")), " "), f"array_to_string({LAST_SQL}, ' ')"),
    "F7_toc_key": (T.toc_key, TOC_SQL),
    "F8_record_hash": (lambda: F.sha2(T.record_key(), 256), f"sha256({KEY_SQL})"),
    "F9_citation_key": (citation_key, f"(case when len({_clean_name_sql()}) > 3 then {_clean_name_sql()}[1] || 'EtAl' else array_to_string({_clean_name_sql()}, '') end) || coalesce(year, '')"),
    "F12_polish_mostly_upper": (lambda: T.polish_mostly_upper(c("title")), _POLISH.format("title")),
    "F13_unify_pages": (lambda: T.unify_pages(c("pages")), PAGES_SQL),
    "F15_normalise_doi": (lambda: T.normalise_doi(c("doi")), DOI_SQL),
    "F16_unify_language": (lambda: unify_language(c("language")), "case when length(language) = 3 then language else case lower(language) " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGES.items()) + " end end"),
    "F18_unescape_latex": (lambda: T.unescape_latex(F.concat(F.lit(r'M{\"u}ller \& '), c("title"), F.lit(r" {\`e}\~n"))), _latex_sql(r"""('M{\"u}ller \& ' || title || ' {\`e}\~n')""")),
    "F20_standardise_title": (lambda: standardise("title"), r"regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '[.]+$', '')"),
    "F20_standardise_pages": (lambda: standardise("pages"), "case when lower(pages) in ('n.pag.', 'n.pag') then null else pages end"),
    "F21_polish_acronyms": (lambda: polish_acronyms(c("title")), _acronym_sql()),
    "F22_alphabet_language": (lambda: alphabet_language(c("title")), "case " + " ".join(f"when length(regexp_replace(title, '[^{p}]', '', 'g')) / greatest(length(title), 1) > 0.75 then '{k}'" for k, p in ALPHABETS.items()) + " end"),
    "F23b_clean_booktitle": (lambda: clean_booktitle(c("booktitle")), _booktitle_sql()),
    "F25_expected_pages": (lambda: T.expected_pages(c("pages")), _expected_sql()),
    "F29_extract_doi": (lambda: F.array_join(F.regexp_extract_all(c("doi"), F.lit(r"(10\.[0-9]{4,9}/[-._;/:A-Za-z0-9]*)")), ","), r"array_to_string(regexp_extract_all(doi, '10\.[0-9]{4,9}/[-._;/:A-Za-z0-9]*'), ',')"),
    "P14_container_title": (T.container_title, "case when ENTRYTYPE = 'article' then journal when ENTRYTYPE in ('inproceedings', 'proceedings', 'inbook', 'incollection') then booktitle when ENTRYTYPE = 'book' then title when ENTRYTYPE = 'misc' then coalesce(journal, booktitle) end"),
    "P16_citation": (
        lambda: F.concat(F.coalesce("author", F.lit("")), F.lit(" ("), F.coalesce("year", F.lit("")), F.lit(") "), F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("journal", "booktitle", F.lit("")), F.lit(", "), F.coalesce("volume", F.lit("")), F.lit(" ("), F.coalesce("number", F.lit("")), F.lit(")")),
        "coalesce(author, '') || ' (' || coalesce(year, '') || ') ' || coalesce(title, '') || '. ' || coalesce(journal, booktitle, '') || ', ' || coalesce(volume, '') || ' (' || coalesce(number, '') || ')'",
    ),
    "P23_latin_share": (lambda: F.char_length(F.regexp_replace("title", r"[^\p{IsLatin}]", "")) / F.greatest(F.char_length("title"), F.lit(1)) <= 0.75, r"length(regexp_replace(title, '[^\p{Latin}]', '', 'g')) / greatest(length(title), 1) <= 0.75"),
}


def _apply(spark: SparkSession, sf_dir: str, build: Callable[[], Column]) -> DataFrame:
    return records(spark, sf_dir).select("ID", build().alias("value"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("seq", c("title").alias("t"))
    nxt = r.select((F.col("seq") - 1).alias("seq"), F.col("t").alias("u"))
    return r.join(nxt, "seq")


def indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each title with that of the next record."""
    return _pairs(spark, sf_dir).select("seq", F.round(ratio_udf("t", "u"), 6).alias("ratio"))


#: longest common subsequence of two texts that aren't empty, by words of 60 bits: a step for each character of the first and word of the second
LCS_SQL = (
    "list_transform([struct_pack(x := string_split({a}, ''), y := string_split({b}, ''))], lambda p: list_sum(list_transform(list_zip(range(len(p.y) // 60 + 1), "
    "list_reduce(list_transform(p.x, lambda ch: list_transform(range(len(p.y) // 60 + 1), lambda w: cast(list_sum(list_transform(range(60), lambda j: case when p.y[w * 60 + j + 1] = ch then 1::bigint << j else 0 end)) as bigint))), "
    "lambda v, m: list_reduce(list_transform(range(1, len(v) + 1), lambda w: [v[w], m[w]]), "
    "lambda s, e: list_concat([(e[1] + (e[1] & e[2]) + s[1]) >> 60], s[2:], [((e[1] + (e[1] & e[2]) + s[1]) & FULL) | (e[1] & ~e[2])]), [0::bigint])[2:], "
    "list_transform(range(len(p.y) // 60 + 1), lambda w: FULL::bigint))), "
    "lambda z: greatest(least(60, len(p.y) - 60 * z[1]), 0) - bit_count(z[2] & ((1::bigint << cast(greatest(least(60, len(p.y) - 60 * z[1]), 0) as integer)) - 1)))))[1]"
).replace("FULL", str((1 << 60) - 1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(_apply, build=build) for k, (build, _) in _FUNCTIONS.items()} | {"F30_indel_ratio": indel}


def oracle_sql() -> dict[str, str]:
    out = {k: with_records(f"select ID, {sql} as value from r") for k, (_, sql) in _FUNCTIONS.items()}
    lcs = LCS_SQL.format(a="t", b="u")
    out["F30_indel_ratio"] = with_records(f"""
        with p as (select a.seq, a.title as t, b.title as u from r a join r b on b.seq = a.seq + 1)
        select seq, round(case when t is null or u is null then null when t = '' and u = '' then 100.0 when t = '' or u = '' then 0.0 else 200.0 * {lcs} / (length(t) + length(u)) end, 6) as ratio from p""")
    return out

"""Quality model: metadata checks as boolean columns, evaluated in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import percent_upper
from recordloom.schema import FORBIDDEN, FORTHCOMING, REQUIRED, UNKNOWN

# fixed values of the checks
ERRONEOUS_TERMS = {
    "author": ["http", "university", "orcid", "student", "harvard", "conference", "mrs", "hochschule"],
    "title": ["research paper", "completed research", "research in progress", "full research paper"],
}
BROKEN_TITLES = ["A I S ssociation for nformation ystems", "The International Journal of Information Systems Applications Chairman of the Editorial Board"]
ISBN = r"^(ISBN(-1[03])?:? )?([-0-9 ]{17}|[-0-9X ]{13}|[0-9X]{10})$|^(97[89][- ]?)?[0-9]{1,5}[- ]?([0-9]+[- ]?){2}[0-9X]$"

c = F.col


def known(field: str) -> Column:
    return c(field).isNotNull() & (c(field) != UNKNOWN)


def _names(field: str) -> Column:
    return F.split(c(field), " and ")


def _count(text: Column, keep: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{keep}]", ""))


def missing(field: str) -> Column:
    """A field that the type requires is absent or UNKNOWN; a forthcoming article needs no volume and number."""
    types = [t for t, fields in REQUIRED.items() if field in fields]
    out = c("ENTRYTYPE").isin(types) & ~known(field)
    return out & (F.coalesce(c("year"), F.lit("")) != FORTHCOMING) if field in ("volume", "number") else out


def incomplete(field: str) -> Column:
    v = c(field)
    cut = v.endswith("...") | v.endswith("…")
    if field != "author":
        return known(field) & cut
    named = v.contains(", and ") | F.rtrim(v).endswith(",") | ~v.contains(",")
    return known(field) & ~(v.startswith("{") & v.endswith("}")) & (cut | named)


def _bare(field: str) -> Column:
    return F.replace(F.lower(c(field)), F.lit("the "), F.lit(""))


def mostly_caps(field: str) -> Column:
    v = c(field)
    out = known(field) & (percent_upper(F.replace(v, F.lit(" and "), F.lit(""))) >= 0.7) & (F.upper(v) != "PLOS ONE")
    if field in ("journal", "booktitle"):
        return out & (F.char_length(v) >= 6)
    return out & ~((c("ENTRYTYPE") == "online") & (F.char_length(v) < 10)) if field == "title" else out


def bad_separators(field: str) -> Column:
    v = F.regexp_replace(c(field), r'[{}]|\([\p{L}\p{N}_]*\)|"[\p{L}\p{N}_]*"', "")
    names = F.split(F.replace(F.replace(v, F.lit(" and others"), F.lit("")), F.lit(" et al."), F.lit("")), " and ")
    shaped = F.forall(names, lambda n: n.rlike(r"^[\p{L}\p{N}_ .‐'’-]*, [\p{L}\p{N}_ .‐'’-]*$"))
    upper = F.forall(names, lambda n: F.forall(F.split(n, ","), lambda p: p.rlike(r"\p{Lu}")))
    return ~c(field).contains(",") | ~shaped | ~upper


def broken_title(field: str) -> Column:
    v = c(field)
    return v.isin(BROKEN_TITLES) | (_count(v, "0-9") > _count(v, r"\p{L}")) | (~v.contains(" ") & v.rlike("[_.0-9]"))


def _particle(field: str) -> Column:
    return F.exists(_names(field), lambda n: n.endswith(" vom") | n.startswith("vom ") | n.endswith(" von") | n.startswith("von "))


def _swapped_range(field: str) -> Column:
    return c(field).rlike("^[0-9]+--[0-9]+$") & (F.split_part(c(field), F.lit("--"), F.lit(1)).try_cast("long") > F.split_part(c(field), F.lit("--"), F.lit(2)).try_cast("long"))


_container = [f for f in ("journal", "booktitle")]

#: number -> defect code
CODES = {
    1: "missing", 2: "incomplete-field", 3: "inconsistent-with-entrytype", 4: "inconsistent-content", 5: "container-title-abbreviated",
    6: "identical-values-between-title-and-container", 7: "mostly-all-caps", 8: "doi-not-matching-pattern", 10: "isbn-not-matching-pattern",
    11: "pubmedid-not-matching-pattern", 13: "language-format-error", 14: "language-unknown", 15: "year-format", 16: "page-range",
    17: "erroneous-symbol-in-field", 18: "erroneous-term-in-field", 19: "erroneous-title-field", 20: "name-format-separators",
    21: "name-format-titles", 22: "name-abbreviated", 23: "name-particles", 24: "html-tags", 25: "thesis-with-multiple-authors",
}


def checks() -> dict[int, tuple[str, dict[str, Column]]]:
    """number -> (defect code, {field: check}); a check that is null doesn't hold. Columns need a session, so they are made when asked for."""
    terms = lambda f: reduce(lambda a, b: a | b, (F.lower(c(f)).contains(t) for t in ERRONEOUS_TERMS[f]))
    forbidden = {}
    for field in dict.fromkeys(f for fields in FORBIDDEN.values() for f in fields if f != "issue"):
        forbidden[field] = c(field).isNotNull() & c("ENTRYTYPE").isin([t for t, fields in FORBIDDEN.items() if field in fields])
    return {
        1: (CODES[1], {f: missing(f) for f in ("author", "title", "year", "journal", "booktitle", "volume", "number", "publisher", "school", "url")}),
        2: (CODES[2], {f: incomplete(f) for f in ("title", "journal", "booktitle", "author", "abstract")}),
        3: (CODES[3], forbidden),
        4: (CODES[4], {
            "journal": F.lower(c("journal")).contains("conference") | F.lower(c("journal")).contains("workshop"),
            "booktitle": F.lower(c("booktitle")).contains("journal"),
        }),
        5: (CODES[5], {
            "journal": known("journal") & (F.char_length("journal") < 6) & (F.upper("journal") == c("journal")),
            "booktitle": known("booktitle") & (((F.char_length("booktitle") < 6) & (F.upper("booktitle") == c("booktitle"))) | c("booktitle").contains("Proc.")),
        }),
        6: (CODES[6], {f: known("title") & known(f) & (_bare("title") == _bare(f)) for f in _container}),
        7: (CODES[7], {f: mostly_caps(f) for f in ("title", "author", "journal", "booktitle")}),
        8: (CODES[8], {"doi": ~c("doi").rlike(r"^10.[0-9]{4,9}/")}),
        10: (CODES[10], {"isbn": ~c("isbn").rlike(ISBN)}),
        11: (CODES[11], {"pubmedid": ~c("pubmedid").rlike(r"^[0-9]{1,8}(\.[0-9])?$")}),
        13: (CODES[13], {"language": F.char_length("language") != 3}),
        14: (CODES[14], {"title": known("title") & c("language").isNull()}),
        15: (CODES[15], {"year": known("year") & ~c("year").rlike("^[0-9]{4}$")}),
        16: (CODES[16], {"pages": _swapped_range("pages")}),
        17: (CODES[17], {f: c(f).rlike("[�™]") for f in ("author", "title", "journal", "booktitle", "abstract")}),
        18: (CODES[18], {f: terms(f) for f in ERRONEOUS_TERMS}),
        19: (CODES[19], {"title": known("title") & broken_title("title")}),
        20: (CODES[20], {"author": known("author") & bad_separators("author")}),
        21: (CODES[21], {"author": F.lower(F.concat(F.lit(" "), F.regexp_replace("author", "[,.]", " "), F.lit(" "))).rlike(" (dr|phd|prof) ")}),
        22: (CODES[22], {"author": F.regexp_replace("author", "[ .]+$", "").rlike("(and others|et al)$")}),
        23: (CODES[23], {"author": _particle("author")}),
        24: (CODES[24], {f: c(f).rlike("&#[0-9]+;") for f in ("author", "title", "journal", "booktitle", "abstract", "keywords")}),
        25: (CODES[25], {"author": c("ENTRYTYPE").isin("thesis", "phdthesis", "mastersthesis") & c("author").contains(" and ")}),
    }


def with_defects(records: DataFrame, only: list[int] | None = None) -> DataFrame:
    """records plus ``defects``: array of (field, code), from one projection. Curated records (column ``curated``) have none."""
    found = []
    for n, (code, by_field) in checks().items():
        if only is None or n in only:
            for field, check in by_field.items():
                found.append(F.when(check & c("curated").isNull(), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))))
    return records.withColumn("defects", F.array_compact(F.array(*found)))


def defect_rows(records: DataFrame, only: list[int] | None = None) -> DataFrame:
    # an outer explode, filtered afterwards: else the whole array is computed again for a filter ahead of it
    return with_defects(records, only).select("ID", F.explode_outer("defects").alias("d")).filter("d is not null").select("ID", "d.field", "d.code")


def fatal_defects() -> Column:
    """Defects that keep a record from being prepared automatically."""
    title = F.coalesce(c("title"), F.lit(""))
    return (
        ~known("title") | ~known("author") | ~known("year")
        | (~known("journal") & ~known("booktitle") & c("ENTRYTYPE").isin("article", "inproceedings"))
        | F.coalesce(_bare("title") == _bare("journal"), F.lit(False)) | F.coalesce(_bare("title") == _bare("booktitle"), F.lit(False))
        | F.lower(title).startswith("doi:") | (_count(title, "0-9") > _count(title, r"\p{L}"))
    )


def set_prepared(force: bool = False) -> Column:
    """The state that preparing gives: records with fatal defects need manual preparation."""
    return F.lit("md_prepared") if force else F.when(fatal_defects(), "md_needs_manual_preparation").otherwise("md_prepared")

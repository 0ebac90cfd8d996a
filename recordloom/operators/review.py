"""Prescreen and screen rules: records -> records with a new status, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.schema import POST

c = F.col

# fixed values: titles of material that goes with publications
COMPLEMENTARY_PARTS = [
    "about our authors", "author index", "index of authors", "list of reviewers", "issue information", "call for papers", "back matter", "front matter", "research spotlights",
    "acknowledgment of reviewers", "about authors", "subject index to volume", "information for authors", "instructions to authors", "authors index to volume",
    "acknowledgment to reviewers", "subject index for volume",
]
COMPLEMENTARY_TITLES = [
    "editorial board", "calendar", "announcement", "announcements", "events", "international board of editors", "index", "subject index", "issue information", "keyword index",
    "about the authors", "thanks to reviewers", "contents", "acknowledgments", "volume information", "volume index", "acknowledgement to referees", "contents index", "index to advertisers",
    "about this issue",
]
COMPLEMENTARY_STARTS = ["abstracts", "poster session"]


def any_of(conditions: list[dict[str, str]]) -> Column:
    """OR over dictionaries of field values, each an AND of equalities."""
    return reduce(lambda a, b: a | b, (reduce(lambda x, y: x & y, (c(k) == v for k, v in d.items())) for d in conditions))


def matching(records: DataFrame, conditions: list[dict[str, str]]) -> DataFrame:
    return records.filter(any_of(conditions))


def is_complementary(title: str = "title") -> Column:
    t = F.trim(F.lower(title))
    parts = reduce(lambda a, b: a | b, (t.contains(x) for x in COMPLEMENTARY_PARTS))
    starts = reduce(lambda a, b: a | b, (t.startswith(x) for x in COMPLEMENTARY_STARTS))
    return F.coalesce(parts | t.isin(COMPLEMENTARY_TITLES) | starts, F.lit(False))


@dataclass
class Scope:
    """Rules of the scope prescreen; an empty rule isn't applied."""

    entrytypes: list[str] = field(default_factory=list)
    exclude_outlets: list[dict[str, str]] = field(default_factory=list)
    include_outlets: list[dict[str, str]] = field(default_factory=list)
    time_from: int | None = None
    time_to: int | None = None
    exclude_complementary: bool = False
    exclude_predatory: bool = False
    require_ranked: bool = False
    languages: list[str] = field(default_factory=list)


def scope_reason(scope: Scope) -> Column:
    """Why a record is out of scope, null if it is not. A later rule replaces the reason of an earlier one, so rules are asked last to first."""
    year = c("year").try_cast("int")
    rules: list[tuple[Column, str]] = []
    if scope.exclude_predatory:
        rules.append((c("predatory"), "predatory_journals"))
    if scope.entrytypes:
        rules.append((~c("ENTRYTYPE").isin(scope.entrytypes), "not in ENTRYTYPEScope"))
    if scope.exclude_outlets:
        rules.append((reduce(lambda a, b: a | b, (c(k) == v for d in scope.exclude_outlets for k, v in d.items())), "in OutletExclusionScope"))
    if scope.include_outlets:
        inside = reduce(lambda a, b: a | b, (F.coalesce(c(k) == v, F.lit(False)) for d in scope.include_outlets for k, v in d.items()))
        rules.append((~inside, "not in OutletInclusionScope"))
    if scope.time_from is not None:
        rules.append((F.when(c("year").isNull(), F.lit(0)).otherwise(year) < scope.time_from, f"not in TimeScopeFrom (>{scope.time_from})"))
    if scope.time_to is not None:
        rules.append((F.when(c("year").isNull(), F.lit(5000)).otherwise(year) > scope.time_to, f"not in TimeScopeTo (<{scope.time_to})"))
    if scope.exclude_complementary:
        rules.append((F.lower("title").isin(COMPLEMENTARY_PARTS + COMPLEMENTARY_TITLES), "complementary material"))
    if scope.require_ranked:
        rules.append((~c("ranked"), "not in ranking"))
    if scope.languages:
        rules.append((~c("language").isin(scope.languages), "not in language scope"))
    out = None
    for cond, why in reversed(rules):
        out = F.when(cond, why) if out is None else out.when(cond, why)
    return out if out is not None else F.lit(None).cast("string")


def scope_prescreen(records: DataFrame, scope: Scope) -> DataFrame:
    """Records that wait for the prescreen get a status and, if excluded, the reason."""
    waiting = c("status") == "md_processed"
    out = records.withColumn("prescreen_exclusion", F.when(waiting, scope_reason(scope)))
    return out.withColumn("status", F.when(c("prescreen_exclusion").isNotNull(), "rev_prescreen_excluded").when(waiting, "rev_prescreen_included").otherwise(c("status")))


def exclude(records: DataFrame, condition: Column, reason: str) -> DataFrame:
    """Exclude what meets the condition, and drop its UNKNOWN fields."""
    hit = F.coalesce(condition, F.lit(False))
    fields = [f for f in ("author", "title", "year", "journal", "booktitle", "volume", "number", "pages") if f in records.columns]
    return records.withColumns(
        {f: F.when(hit & (c(f) == "UNKNOWN"), F.lit(None)).otherwise(c(f)) for f in fields}
        | {"prescreen_exclusion": F.when(hit, reason), "status": F.when(hit, "rev_prescreen_excluded").otherwise(c("status"))}
    )


def select_ids(records: DataFrame, ids: DataFrame, include: bool, force: bool = False) -> DataFrame:
    """Include or exclude listed records (ids: ID); without ``force`` only those that wait for the prescreen."""
    hit = c("_listed").isNotNull() & (F.lit(force) | (c("status") == "md_processed"))
    marked = records.join(ids.select("ID").distinct().withColumn("_listed", F.lit(1)), "ID", "left")
    return marked.withColumn("status", F.when(hit, "rev_prescreen_included" if include else "rev_prescreen_excluded").otherwise(c("status"))).drop("_listed")


def criteria_after_inclusion(criteria: list[str]) -> str:
    return ";".join(f"{x}=in" for x in criteria) if criteria else "NA"


def screen(records: DataFrame, decision: Column, criteria: list[str]) -> DataFrame:
    """decision: include flag. Included records meet all criteria; excluded ones keep what was noted."""
    waiting = (c("status") == "pdf_prepared") & decision.isNotNull()
    return records.withColumns({
        "screening_criteria": F.when(waiting & decision, criteria_after_inclusion(criteria)).otherwise(c("screening_criteria")),
        "status": F.when(waiting, F.when(decision, "rev_included").otherwise("rev_excluded")).otherwise(c("status")),
    })


def add_criterion(records: DataFrame, name: str, all_criteria: list[str]) -> DataFrame:
    """A new criterion has to be decided: included records go back, excluded ones stay excluded."""
    screened = c("status").isin("rev_included", "rev_excluded", "rev_synthesized")
    none = screened & c("screening_criteria").isNull()
    return records.withColumns({
        "screening_criteria": F.when(none, ";".join(f"{x}=TODO" for x in all_criteria)).when(screened, F.concat("screening_criteria", F.lit(f";{name}=TODO"))).otherwise(c("screening_criteria")),
        "status": F.when(none | c("status").isin("rev_included", "rev_synthesized"), "pdf_prepared").otherwise(c("status")),
    })


def delete_criterion(records: DataFrame, name: str) -> DataFrame:
    """Without the criterion, a record that no other one excludes or leaves open is included."""
    screened = c("status").isin("rev_included", "rev_excluded", "rev_synthesized")
    left = F.array_join(F.filter(F.split("screening_criteria", ";"), lambda x: F.split_part(x, F.lit("="), F.lit(1)) != name), ";")
    out = records.withColumn("screening_criteria", F.when(screened, left).otherwise(c("screening_criteria")))
    free = (c("status") == "rev_excluded") & ~c("screening_criteria").rlike("=(out|TODO)")
    return out.withColumn("status", F.when(free, "rev_included").otherwise(c("status")))


def criteria_violations(records: DataFrame, criteria: list[str]) -> DataFrame:
    """Screened records whose criteria don't go with their status."""
    pattern = lambda values: "^" + ";".join(f"{x}=({values})" for x in criteria) + "$"
    value = F.coalesce("screening_criteria", F.lit(""))
    included = c("status").isin("rev_included", "rev_synthesized") & ~value.rlike(pattern("in"))
    excluded = (c("status") == "rev_excluded") & (~value.rlike(pattern("in|out")) | ~value.contains("=out"))
    early = ~c("status").isin(POST["pdf_prepared"]) & (value != "")
    problem = F.when(included, "included record does not meet all criteria").when(excluded, "excluded record without a reason").when(early, "criteria before the screen")
    return records.select("ID", "status", "screening_criteria", problem.alias("problem")).filter("problem is not null")


def remove_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "ID", "left_anti")

"""Report and order-dependent queries (A*, W*, S*), with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import history as H
from recordloom.operators import reports as R
from recordloom.plans.fixtures import records, with_records
from recordloom.plans.scalars import DOI_SQL, citation_key
from recordloom.plans.scalars import oracle_sql as scalar_sql
from recordloom.schema import POST

c = F.col


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outlet_by_year(records(spark, sf_dir))


def a9_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and year with margins."""
    return R.crosstab(_t(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("order_year")), "o_orderpriority", "order_year")


def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by defect with margins."""
    from recordloom.operators.quality import with_defects

    r = with_defects(records(spark, sf_dir)).select("ID", "origins", F.explode_outer("defects").alias("d")).filter("d is not null").select("ID", "origins", "d.code").distinct()
    d = r.select("code", F.explode(F.split("origins", ";")).alias("o")).select("code", F.split_part("o", F.lit("/"), F.lit(1)).alias("source"))
    return R.crosstab(d, "source", "code")


def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("ENTRYTYPE").agg(F.count("*").alias("n"), F.count_if(c("status") == "md_needs_manual_preparation").alias("n_manual"))


def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as citations: the part is the reference, the order the paper, the quantity the number of mentions."""
    return R.threshold_grid(_t(spark, sf_dir, "lineitem").select(c("l_partkey").alias("ref"), c("l_orderkey").alias("paper"), c("l_quantity").cast("int").alias("n_intext")))


def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels")
    return R.agreement(labels.select("doc_id", c("quality").alias("label")), labels.select("doc_id", (F.lit(1) - c("toxic")).alias("label")), "doc_id", "label")


def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, labels = records(spark, sf_dir), _t(spark, sf_dir, "labels")
    matched = r.join(labels.select(c("doc_id").alias("seq")).distinct(), "seq", "left_semi").agg(F.count("*").alias("m"))
    return r.agg(F.count("*").alias("n")).crossJoin(matched).select("n", "m", (c("m") / c("n")).alias("rate"))


def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("year", "journal").agg(F.count("*").alias("n"))


def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_values(records(spark, sf_dir), "journal")


def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_counts(records(spark, sf_dir), "keywords", stop=["topic0"])


def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent link target of each page."""
    links = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'))).alias("target"))
    n = links.groupBy("page_id", "target").agg(F.count("*").alias("n"))
    return n.groupBy("page_id").agg(F.max("n").alias("n"), F.min_by("target", F.struct((-c("n")).alias("k"), "target")).alias("target"))


def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events finished by day as a share of the day with the most: running total scaled to its maximum."""
    d = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    run = d.selectExpr("day", "sum(n) over (order by day) as total")
    return run.crossJoin(d.agg(F.sum("n").alias("top"))).select("day", "total", F.floor(c("total") * 100 / c("top")).cast("long").alias("percent"))


def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow counts of a review."""
    r = records(spark, sf_dir)
    named = {"identified": F.lit(True), "screened": c("status").isin(POST["md_processed"]), "retrieved": c("status").isin(POST["pdf_imported"]), "assessed": c("status").isin(POST["pdf_prepared"]), "included": c("status").isin("rev_included", "rev_synthesized")}
    one = r.agg(*(F.count_if(v).alias(k) for k, v in named.items()))
    return one.unpivot([], list(named), "step", "n")


def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels")
    return R.ambiguous(labels, F.floor(c("doc_id") / 3).cast("long"), "quality")


def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).agg(F.avg((c("doi").isNull() & c("url").isNull() & c("pubmedid").isNull()).cast("double")).alias("without_ids"))


def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("ID"), c("l_linenumber").alias("endpoint"), (c("l_linestatus") == "F").alias("done"))
    return R.synthesised(o).groupBy("status").agg(F.count("*").alias("n"))


def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured table with a row for each DOI: ids that stand twice, and rows with a field still open."""
    r = records(spark, sf_dir).filter("doi is not null")
    return R.incomplete_rows(r, "doi", ["title", "author", "year", "volume"], "UNKNOWN")


def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shared_origins(records(spark, sf_dir))


def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_matrix(records(spark, sf_dir))


def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.unique_ids(records(spark, sf_dir), F.coalesce(citation_key(), F.lit("Anonymous")))


def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.lpad(c("doc_id").cast("string"), 8, "0")).alias("source_identifier"), "doc_id")
    known = d.filter("doc_id % 4 = 0").select("source_identifier", F.lpad((F.lit(1) + F.floor(c("doc_id") / 4)).cast("string"), 6, "0").alias("id"))
    return H.next_ids(known, d.select("source_identifier"), "source_identifier")


def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.functions.text import normalise_doi

    r = records(spark, sf_dir).filter("doi is not null").withColumn("score", F.char_length(F.coalesce("title", F.lit(""))))
    return H.best_per_key(r, normalise_doi(c("doi")), "score", "seq", 50)


def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.change_log(_t(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"]).groupBy("kind", "fields").agg(F.count("*").alias("n"))


_EVENT_STATE = {"view": "md_imported", "click": "md_prepared", "signup": "md_processed", "purchase": "rev_prescreen_included", "error": "rev_prescreen_excluded"}


def _event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in _EVENT_STATE.items() for x in kv])
    return _t(spark, sf_dir, "events").select("user_id", "event_id", table[c("event_type")].alias("state"))


def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.transitions_taken(_event_states(spark, sf_dir), "user_id", "event_id", "state")


def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.split_for_coders(records(spark, sf_dir).select("ID"), 3)


def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a journal in numeric order."""
    r = records(spark, sf_dir).filter("journal is not null").select("journal", "volume", "number").distinct()
    return r.selectExpr(
        "journal", "volume", "number", "row_number() over (partition by journal order by coalesce(try_cast(volume as int), 0) desc, coalesce(try_cast(number as int), 0) desc, volume, number) as place"
    )


def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.filter(F.exists(F.array("title", "author", "journal", "booktitle", "year", "keywords"), lambda x: F.lower(x).contains("topic1,"))).select("ID")


def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    a, b = r.filter("seq % 2 = 0").select("journal", "year"), r.filter("seq % 3 = 0").select("journal", "year")
    tag = lambda df, name: df.withColumn("op", F.lit(name))
    return tag(a.exceptAll(b), "except_all").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.union(b).distinct(), "union")).groupBy("op").agg(F.count("*").alias("n"))


def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as versions of a file: does each begin with the one before?"""
    v = _t(spark, sf_dir, "conversations").select("conv_id", "turn", c("text").alias("content"))
    return H.appended_only(v, "conv_id", "turn", "content").groupBy("appended").agg(F.count("*").alias("n"))


def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that aren't unique."""
    return records(spark, sf_dir).groupBy(F.lower("title").alias("key")).agg(F.count("*").alias("n")).filter("n > 1 and key is not null")


def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a source that aren't imported yet."""
    r = records(spark, sf_dir).filter("seq % 3 <> 0").select(F.explode(F.split("origins", ";")).alias("origin"))
    src = _t(spark, sf_dir, "documents").select(F.concat("source", F.lit(".bib/"), F.lpad(c("doc_id").cast("string"), 6, "0")).alias("origin"))
    return src.join(r, "origin", "left_anti")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "A9_outlet_by_year": a9, "A9_orders_crosstab": a9_orders, "A10_source_by_defect": a10, "A11_entrytypes": a11, "A12_threshold_grid": a12, "A15_agreement": a15, "A16_matching_rate": a16,
        "A17_by_year_and_journal": a17, "A18_top_outlets": a18, "A19_keywords": a19, "A20_common_link": a20, "A21_burn_down": a21, "A23_flow_counts": a23, "A24_ambiguous_labels": a24,
        "A25_without_ids": a25, "A26_synthesis": a26, "A27_structured_data": a27, "A28_shared_origins": a28, "A30_source_matrix": a30, "W1_unique_ids": w1, "W3_next_ids": w3, "W4_best_per_key": w4,
        "W5_change_log": w5, "W6_transitions": w6, "W9_coders": w9, "W10_issue_order": w10, "W11_text_search": w11, "W13_set_operations": w13, "S16_unique_check": s16, "S19_new_rows": s19, "S20_append_only": s20,
    }


def oracle_sql() -> dict[str, str]:
    from recordloom.plans.quality import _defects_sql
    from recordloom.operators.quality import CODES
    from recordloom.operators.status import TRANSITIONS

    inn = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    key = scalar_sql()["F9_citation_key"].rpartition("select ID, ")[2].rpartition(" as value from r")[0]
    suffix = "case when n = 1 then '' when n - 2 < 26 then chr(cast(n - 2 + 97 as integer)) when n - 2 < 702 then chr(cast((n - 2) // 26 - 1 + 97 as integer)) || chr(cast((n - 2) % 26 + 97 as integer)) else chr(cast((n - 704) // 676 + 97 as integer)) || chr(cast((n - 704) // 26 % 26 + 97 as integer)) || chr(cast((n - 704) % 26 + 97 as integer)) end"
    trans = "(values " + ", ".join(f"('{o}', '{a}', '{b}')" for o, a, b in TRANSITIONS) + ") t(operation, source, dest)"
    state = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _EVENT_STATE.items()) + " end"
    num = lambda f: f"coalesce(try_cast({f} as integer), 0)"
    own = {
        "A9_outlet_by_year": """with y as (select coalesce(journal, booktitle) as outlet, cast(year as integer) as y from r where regexp_matches(year, '^[0-9]{4}$') and coalesce(journal, booktitle) is not null),
            b as (select min(y) as a, max(y) as z from y), o as (select outlet, y from y union all select 'All', y from y),
            g as (select n.outlet, s.y, count(o.y) as n from (select distinct outlet from o) n cross join (select unnest(range(a, z + 1)) as y from b) s left join o on o.outlet = n.outlet and o.y = s.y group by all)
            select outlet, (select a from b) as first_year, string_agg(cast(n as string), ',' order by y) as counts, cast(sum(n) as bigint) as total from g group by outlet""",
        "A10_source_by_defect": f"""with d as (select distinct ID, code from ({_defects_sql(list(CODES))})), s as (select ID, split_part(unnest(string_split(origins, ';')), '/', 1) as source from r)
            select case when grouping(source) = 1 then 'All' else source end as source, case when grouping(code) = 1 then 'All' else code end as code, count(*) as n from d join s on s.ID = d.ID group by cube (source, code)""",
        "A11_entrytypes": "select ENTRYTYPE, count(*) as n, count(*) filter (status = 'md_needs_manual_preparation') as n_manual from r group by ENTRYTYPE",
        "A16_matching_rate": "select n, m, m / n as rate from (select count(*) as n, count(*) filter (seq in (select doc_id from labels)) as m from r)",
        "A17_by_year_and_journal": "select year, journal, count(*) as n from r group by year, journal",
        "A18_top_outlets": "select journal, count(*) as n from r where journal is not null group by journal having count(*) > 5 order by n desc, journal limit 10",
        "A19_keywords": "select keyword, count(*) as n from (select unnest(string_split(keywords, ', ')) as keyword from r) where keyword not in ('', 'topic0') group by keyword having count(*) > 2",
        "A23_flow_counts": f"select 'identified' as step, count(*) as n from r union all select 'screened', count(*) from r where status in {inn(POST['md_processed'])} union all select 'retrieved', count(*) from r where status in {inn(POST['pdf_imported'])} union all select 'assessed', count(*) from r where status in {inn(POST['pdf_prepared'])} union all select 'included', count(*) from r where status in ('rev_included', 'rev_synthesized')",
        "A25_without_ids": "select avg(case when doi is null and url is null and pubmedid is null then 1.0 else 0.0 end) as without_ids from r",
        "A28_shared_origins": "select origin, count(distinct ID) as n, min(ID) as first_id from (select ID, unnest(string_split(origins, ';')) as origin from r) where not starts_with(origin, 'md_') group by origin having count(distinct ID) > 1",
        "A30_source_matrix": f"select coalesce(journal, booktitle) as outlet, source, count(*) filter (status = 'md_imported') as n_imported, count(*) filter (status in {inn(POST['md_processed'])}) as n_processed, count(*) filter (status in {inn(POST['pdf_prepared'])}) as n_prepared from (select *, split_part(unnest(string_split(origins, ';')), '/', 1) as source from r) where status <> 'rev_prescreen_excluded' and coalesce(journal, booktitle) is not null group by 1, 2",
        "W1_unique_ids": f"with b as (select ID, seq, coalesce({key}, 'Anonymous') as base from r), x as (select ID, base, row_number() over (partition by lower(base) order by seq) as n from b) select ID, base || {suffix} as new_id from x",
        "W4_best_per_key": f"with k as (select {DOI_SQL} as key, length(coalesce(title, '')) as score, seq from r where doi is not null), x as (select *, row_number() over (partition by key order by score desc, seq) as n from k) select key, cast(score as integer) as score, seq as tie from x where n = 1 order by score desc, seq limit 50",
        "W9_coders": "with x as (select ID, row_number() over (order by ID) - 1 as n, count(*) over () // 3 as k from r) select ID, cast(n // k as integer) as coder from x where n // k < 3",
        "W10_issue_order": f"select journal, volume, number, row_number() over (partition by journal order by {num('volume')} desc, {num('number')} desc, volume nulls first, number nulls first) as place from (select distinct journal, volume, number from r where journal is not null)",
        "W11_text_search": "select ID from r where " + " or ".join(f"lower({f}) like '%topic1,%'" for f in ("title", "author", "journal", "booktitle", "year", "keywords")),
        "W13_set_operations": "with a as (select journal, year from r where seq % 2 = 0), b as (select journal, year from r where seq % 3 = 0) select 'except_all' as op, count(*) as n from (select * from a except all select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'union', count(*) from (select * from a union select * from b)",
        "S16_unique_check": "select lower(title) as key, count(*) as n from r where title is not null group by 1 having count(*) > 1",
        "S19_new_rows": "with o as (select unnest(string_split(origins, ';')) as o from r where seq % 3 <> 0) select source || '.bib/' || lpad(cast(doc_id as string), 6, '0') as origin from documents where source || '.bib/' || lpad(cast(doc_id as string), 6, '0') not in (select o from o)",
    }
    return {k: with_records(v) for k, v in own.items()} | {
        "A9_orders_crosstab": "select case when grouping(o_orderpriority) = 1 then 'All' else o_orderpriority end as o_orderpriority, case when grouping(y) = 1 then 'All' else cast(y as string) end as order_year, count(*) as n from (select o_orderpriority, year(o_orderdate) as y from orders) group by cube (o_orderpriority, y)",
        "A12_threshold_grid": "with c as (select l_partkey as ref, cast(l_quantity as integer) as q from lineitem), g as (select i, ref, count(*) as m from c, (select unnest(range(1, 20)) as i) where q >= i group by i, ref) select cast(i as integer) as i, cast(j as integer) as j, cast(count(*) as bigint) as n from g, (select unnest(range(1, 20)) as j) where m >= j group by i, j",
        "A15_agreement": "select count(*) as n, avg(case when a.quality = 1 - b.toxic then 1.0 else 0.0 end) as agreement from labels a join labels b on a.doc_id = b.doc_id",
        "A20_common_link": "with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) as target from pages), n as (select page_id, target, count(*) as n from l group by 1, 2), x as (select *, row_number() over (partition by page_id order by n desc, target) as k from n) select page_id, n, target from x where k = 1",
        "A21_burn_down": "with d as (select cast(ts as date) as day, count(*) as n from events group by 1) select day, cast(sum(n) over (order by day) as bigint) as total, cast(floor(sum(n) over (order by day) * 100 / (select sum(n) from d)) as bigint) as percent from d",
        "A24_ambiguous_labels": "select cast(floor(doc_id / 3) as bigint) as key, count(*) as n, count(distinct quality) as n_labels from labels group by 1 having count(*) > 1 and count(distinct quality) > 1",
        "A26_synthesis": "select status, count(*) as n from (select l_orderkey, case when bool_and(l_linestatus = 'F') then 'rev_synthesized' else 'rev_included' end as status from lineitem group by 1) group by 1",
        "A27_structured_data": with_records("select doi, count(*) as n, bool_or('UNKNOWN' in (title, author, year, volume)) as open from (select doi, coalesce(title, '') as title, coalesce(author, '') as author, coalesce(year, '') as year, coalesce(volume, '') as volume from r where doi is not null) group by doi having count(*) > 1 or bool_or('UNKNOWN' in (title, author, year, volume))"),
        "W3_next_ids": "with d as (select source || '-' || lpad(cast(doc_id as string), 8, '0') as source_identifier, doc_id from documents), k as (select source_identifier, lpad(cast(1 + doc_id // 4 as string), 6, '0') as id from d where doc_id % 4 = 0) select * from k union all select source_identifier, lpad(cast((select max(cast(id as bigint)) from k) + row_number() over (order by source_identifier) as string), 6, '0') from d where doc_id % 4 <> 0",
        "W5_change_log": "with x as (select *, row_number() over w as n, lag(role) over w as pr, lag(text) over w as pt from conversations window w as (partition by conv_id order by turn)), y as (select case when n = 1 then 'new' when role is not distinct from pr and text is not distinct from pt then 'same' else 'changed' end as kind, case when n = 1 then '' else array_to_string(list_filter([case when role is distinct from pr then 'role' end, case when text is distinct from pt then 'text' end], lambda v: v is not null), ',') end as fields from x) select kind, fields, count(*) as n from y group by 1, 2",
        "W6_transitions": f"with h as (select user_id, event_id, {state} as dest, lag({state}) over (partition by user_id order by event_id) as source from events) select h.user_id, h.event_id, h.source, h.dest, coalesce((select min(operation) from {trans} where t.source = h.source and t.dest = h.dest), 'invalid_transition') as operation from h where h.source is not null and h.source <> h.dest",
        "S20_append_only": "with x as (select text as c, lag(text) over (partition by conv_id order by turn) as b from conversations) select coalesce(starts_with(c, b), true) as appended, count(*) as n from x group by 1",
    }

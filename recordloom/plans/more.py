"""Further queries: full text, metadata items, snapshots, curation (A*, D*, J*, P*, Q*, W*, X*, K7), with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import dedupe as D
from recordloom.operators import fulltext as X
from recordloom.operators import lookup as L
from recordloom.operators import transfer as O
from recordloom.plans.fixtures import records, with_records
from recordloom.plans.scalars import DOI_SQL, TOC_SQL, _slug_sql
from recordloom.schema import POST
from recordloom.sources import transformers

c = F.col


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose issue the index has without them."""
    r = records(spark, sf_dir)
    return L.toc_status(r.filter("not processed"), r.filter("processed")).filter("result = 'not-in-toc'").select("ID", F.lit("record-not-in-toc").alias("code"))


def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_defects(records(spark, sf_dir))


def p34(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(c("doc_id") % 9 == 0, F.concat(F.lit("Downloaded  from here\n"), "text")).otherwise(c("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", X.has_cover_page(text).alias("cover_page"))


def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references of orders to parts."""
    li = _t(spark, sf_dir, "lineitem")
    refs = li.select(c("l_orderkey").alias("paper"), c("l_partkey").alias("key"), F.concat(F.lit("part "), c("l_partkey").cast("string")).alias("title"), c("l_quantity").cast("int").alias("n_intext"), (c("l_returnflag") == "R").alias("in_sample"))
    return X.citation_network(refs)


def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reading_statistics(_t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc"), c("l_suppkey").alias("ID")))


def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First origin of each record by source kind."""
    o = records(spark, sf_dir).select("ID", F.posexplode(F.split("origins", ";")).alias("pos", "origin"))
    kind = F.when(c("origin").startswith("md_"), "metadata").when(c("origin").startswith("web"), "web").otherwise("database")
    return o.withColumn("kind", kind).groupBy("ID").pivot("kind", ["database", "metadata", "web"]).agg(F.min_by("origin", "pos"))


def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average value of each kind of event, largest first."""
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each DOI that the others are merged into."""
    r = records(spark, sf_dir).withColumn("doi", T.normalise_doi(c("doi"))).filter("doi is not null")
    return r.groupBy("doi").agg(F.min_by("ID", D.primary_order()).alias("primary_id"), F.count("*").alias("n"))


def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the best source in issues that have none of it processed become processed."""
    return O.first_source(records(spark, sf_dir))


def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records merged by all of their global ids: each component's smallest id and its size."""
    comp = D.components(D.global_id_pairs(records(spark, sf_dir), max_block=200))
    return comp.groupBy("component").agg(F.count("*").alias("n"))


def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as snapshots: for each conversation the last snapshot whose role differs from the newest one."""
    s = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    newest = s.groupBy("conv_id").agg(F.max_by("role", "turn").alias("now"))
    return s.join(newest, "conv_id").filter(~c("role").eqNullSafe(c("now"))).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other record, over all records, at 0.5 or more."""
    return D.best_of_all(records(spark, sf_dir), 0.5)


def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of another project, found by DOI."""
    r = records(spark, sf_dir)
    return O.import_statuses(r.filter("not processed"), r.filter("processed"), T.normalise_doi(c("doi")))


def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages set by hand; records that were excluded for their language are reset."""
    labels = _t(spark, sf_dir, "labels").select(F.concat(F.lit("R"), F.lpad(c("doc_id").cast("string"), 7, "0")).alias("ID"), F.lit("eng").alias("language"))
    return O.import_languages(records(spark, sf_dir), labels)


def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that stay after the last round; sentinels for none are dropped."""
    return records(spark, sf_dir).select("ID", *(F.when(~c(f).isin("", "NA", "UNKNOWN"), c(f)).alias(f) for f in ("title", "author", "year", "doi")))


def p35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that cite an included one: parts bought together with parts of brand 1."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    chosen = _t(spark, sf_dir, "part").filter("p_brand = 'Brand#1'").select(c("p_partkey").alias("l_partkey"))
    orders = li.join(chosen, "l_partkey", "left_semi").select("l_orderkey").distinct()
    return li.join(orders, "l_orderkey", "left_semi").join(chosen, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_citing"))


def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ from the first earlier one with the same DOI."""
    from pyspark.sql import Window

    w = Window.partitionBy("doi").orderBy("seq")
    r = records(spark, sf_dir).withColumn("doi", T.normalise_doi(c("doi"))).filter("doi is not null")
    r = r.withColumns({"pt": F.first("title").over(w), "py": F.first("year").over(w), "n": F.row_number().over(w)})
    return r.filter("n > 1").select("ID", (~(c("title").eqNullSafe(c("pt")) & c("year").eqNullSafe(c("py")))).alias("changed"))


def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that stand before what an operation needs."""
    from recordloom.operators.status import preceding_states

    before = preceding_states(spark).filter("state = 'pdf_prepared'").select(c("before").alias("status"))
    return records(spark, sf_dir).join(before, "status", "left_semi").groupBy("status").agg(F.count("*").alias("n"))


def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents: journal, volume, the titles of each issue in order, one record for each DOI."""
    r = records(spark, sf_dir).filter("journal is not null and volume is not null").withColumn("doi", F.coalesce(T.normalise_doi(c("doi")), c("ID")))
    one = r.groupBy("journal", "volume", "number", "doi").agg(F.min_by(F.struct("seq", "title"), "seq").alias("t"))
    return one.groupBy("journal", "volume", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.coalesce(t["title"], F.lit(""))), "; ").alias("titles"))


def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as items of a registry, transformed back."""
    r = records(spark, sf_dir)
    date = F.when(c("year").rlike("^[0-9]{4}$"), F.struct(F.array(F.array(c("year").try_cast("int"))).alias("date-parts")))
    authors = F.transform(F.split("author", " and "), lambda n: F.struct(F.split_part(n, F.lit(","), F.lit(1)).alias("family"), F.trim(F.split_part(n, F.lit(","), F.lit(2))).alias("given")))
    item = F.to_json(F.struct(
        c("ID").alias("DOI"), F.when(c("ENTRYTYPE") == "article", "journal-article").when(c("ENTRYTYPE") == "inproceedings", "proceedings-article").otherwise("other").alias("type"), F.array(F.concat(F.lit("<i>"), c("title"), F.lit("</i> &amp; more"))).alias("title"),
        F.array(F.coalesce("journal", "booktitle")).alias("container-title"), "volume", F.col("number").alias("issue"), authors.alias("author"), date.alias("published-online"),
    ))
    return transformers.works(r.filter("author is not null").select(item.alias("item"))).select("doi", "ENTRYTYPE", "title", "author", "year", "journal", "booktitle", "volume", "number", "retracted")


def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).filter("author is not null and author like '%,%'")
    names = F.transform(F.split("author", " and "), lambda n: F.struct(F.struct(F.trim(F.concat(F.trim(F.split_part(n, F.lit(","), F.lit(2))), F.lit(" "), F.split_part(n, F.lit(","), F.lit(1)))).alias("display_name")).alias("author")))
    item = F.to_json(F.struct(
        F.concat(F.lit("https://catalogue.example/"), c("ID")).alias("id"), c("doi"), c("title").alias("display_name"), F.when(c("ENTRYTYPE") == "article", "article").otherwise("other").alias("type"), c("year").alias("publication_year"),
        F.struct("volume", F.col("number").alias("issue"), F.lit("3").alias("first_page"), F.lit("9").alias("last_page")).alias("biblio"), F.struct(F.struct(c("journal").alias("display_name")).alias("source")).alias("primary_location"), names.alias("authorships"),
    ))
    return transformers.open_works(r.filter("author not like '%,' and author not like '{%'").select(item.alias("item"))).select("local_id", "ENTRYTYPE", "title", "year", "journal", "volume", "number", "pages", "doi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "Q12_record_not_in_toc": q12, "Q26_text_defects": q26, "P34_cover_page": p34, "A13_citation_network": a13, "A14_reading_statistics": a14, "A22_source_comparison": a22, "A29_average_runtime": a29, "D6_primary": d6,
        "D11_unmerge_snapshot": d11, "D13_merge_by_global_ids": d13, "D14_first_source": d14, "J14_best_match": j14, "J17_other_decisions": j17, "J19_language_import": j19, "P17_last_round": p17, "P35_forward_search": p35,
        "W7_changed": w7, "W15_precondition": w15, "K7_toc": k7, "X1_registered_works": x1, "X7_open_works": x7,
    }


def oracle_sql() -> dict[str, str]:
    from recordloom.operators.status import TRANSITIONS
    from recordloom.plans.linking import TOC_FOUND_SQL, WORDS_SQL, compared, similarity
    from recordloom.plans.linking import oracle_sql as linking_sql

    from recordloom.schema import RANK

    inn = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    flat = lambda x: f"regexp_replace(lower(translate({x}, '{T.ACCENTED}', '{T.PLAIN}')), '[^a-z0-9]', '', 'g')"
    share = lambda words: f"case when len({words}) > 0 then len(list_filter({words}, lambda w: contains(ft, w))) / len({words}) else 0 end"
    trans = "(values " + ", ".join(f"('{o}', '{a}', '{b}')" for o, a, b in TRANSITIONS) + ") t(operation, source, dest)"
    rank = "case status " + " ".join(f"when '{s}' then {n}" for s, n in RANK.items()) + " end"
    comps = linking_sql()["D5_components"]
    kind = "case when starts_with(origin, 'md_') then 'metadata' when starts_with(origin, 'web') then 'web' else 'database' end"
    with_sql = {
        "Q12_record_not_in_toc": f"{compared()}, {TOC_FOUND_SQL} select ID, 'record-not-in-toc' as code from t where result = 'not-in-toc'",
        "J14_best_match": f"""{compared()}, w as materialized (select ID, {WORDS_SQL} as w from s), t as (select ID, len(w) as n, unnest(w) as x from w), o as (select a.ID as a_ID, b.ID as b_ID, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as jac from t a join t b on a.x = b.x and a.ID <> b.ID group by all having jac >= 0.4 - 1e-12),
            p as (select a_ID, b_ID from (select *, row_number() over (partition by a_ID order by jac desc, b_ID) as place from o) where place <= 5), {similarity()} , best as (select *, row_number() over (partition by a_ID order by sim desc, b_ID) as n from q where sim >= 0.5) select a_ID, b_ID, sim as similarity from best where n = 1""",
        "Q26_text_defects": f"""with f as (select ID, title, author, {flat('text')} as ft, trim(text) = '' as empty, list_filter(list_transform(string_split(title, ' '), lambda w: {flat('w')}), lambda w: w <> '') as tw,
            list_filter(list_transform(string_split(author, ' and '), lambda n: {flat("trim(split_part(n, ',', 1))")}), lambda w: w <> '') as aw from r)
            select ID, 'no-text-in-pdf' as defect from f where empty union all select ID, 'title-not-in-pdf' from f where not empty and title is not null and {share('tw')} <= 0.9
            union all select ID, 'author-not-in-pdf' from f where not empty and author is not null and lower(title) not like '%editorial%' and {share('aw')} <= 0.8""",
        "A22_source_comparison": f"with o as (select ID, unnest(string_split(origins, ';')) as origin, unnest(range(1, len(string_split(origins, ';')) + 1)) as pos from r) select ID, arg_min(origin, pos) filter ({kind} = 'database') as database, arg_min(origin, pos) filter ({kind} = 'metadata') as metadata, arg_min(origin, pos) filter ({kind} = 'web') as web from o group by ID",
        "D6_primary": f"with k as (select ID, {DOI_SQL} as doi, row_number() over (partition by {DOI_SQL} order by {rank} desc, curated is null, regexp_matches(ID, '[a-z]$'), ID) as n, count(*) over (partition by {DOI_SQL}) as m from r where doi is not null) select doi, ID as primary_id, m as n from k where n = 1",
        "D14_first_source": f"with k as materialized (select ID, status, {TOC_SQL} as toc, split_part(origins, '/', 1) as source from r), n as (select toc, source, count(*) as n, bool_or(status in {inn(POST['md_processed'])}) as done from k where toc is not null group by all), b as (select *, row_number() over (partition by toc order by n desc, source) as place from n) select k.ID, k.toc, k.source, 'md_processed' as status from k join b on b.toc = k.toc and b.source = k.source and b.place = 1 and not b.done where status = 'md_prepared'",
        "J17_other_decisions": f"with k as (select ID, seq, status, processed, {DOI_SQL} as doi from r where doi is not null), o as (select doi, arg_min(status, seq) as other from k where processed group by doi) select k.ID, case when other = 'rev_prescreen_excluded' then 'rev_prescreen_excluded' when other in {inn(POST['rev_prescreen_included'])} then 'rev_prescreen_included' end as decision from k join o on o.doi = k.doi where not k.processed",
        "J19_language_import": "select ID, case when l.doc_id is not null then 'eng' else language end as language, case when l.doc_id is not null and status = 'rev_prescreen_excluded' then 'md_prepared' else status end as status from r left join labels l on l.doc_id = r.seq",
        "P17_last_round": "select ID, " + ", ".join(f"case when {f} not in ('', 'NA', 'UNKNOWN') then {f} end as {f}" for f in ("title", "author", "year", "doi")) + " from r",
        "W7_changed": f"with k as (select ID, title, year, first_value(title) over w as pt, first_value(year) over w as py, row_number() over w as n from r where doi is not null window w as (partition by {DOI_SQL} order by seq)) select ID, title is distinct from pt or year is distinct from py as changed from k where n > 1",
        "W15_precondition": f"with recursive b(s) as (select source from {trans} where dest = 'pdf_prepared' union select t.source from b join {trans} on t.dest = b.s) select status, count(*) as n from r where status in (select s from b) group by status",
        "K7_toc": f"with k as (select journal, volume, number, coalesce({DOI_SQL}, ID) as d, arg_min(seq, seq) as seq, first(coalesce(title, '') order by seq) as title from r where journal is not null and volume is not null group by all) select journal, volume, number, string_agg(title, '; ' order by seq) as titles from k group by all",
        "X1_registered_works": """select ID as doi, case when ENTRYTYPE in ('article', 'inproceedings') then ENTRYTYPE else 'misc' end as ENTRYTYPE, trim(regexp_replace(title || '  & more', '\\s+', ' ', 'g')) as title,
            array_to_string(list_transform(string_split(author, ' and '), lambda n: split_part(n, ',', 1) || ', ' || trim(split_part(n, ',', 2))), ' and ') as author,
            case when not regexp_matches(coalesce(year, ''), '^[0-9]{4}$') or (ENTRYTYPE = 'article' and volume is null and number is null) then 'forthcoming' else year end as year, case when ENTRYTYPE = 'article' then coalesce(journal, booktitle) end as journal,
            case when ENTRYTYPE <> 'article' then coalesce(journal, booktitle) end as booktitle, volume, number, false as retracted from r where author is not null""",
        "X7_open_works": f"select ID as local_id, case when ENTRYTYPE = 'article' then 'article' else 'misc' end as ENTRYTYPE, title, year, case when ENTRYTYPE = 'article' then journal end as journal, volume, number, '3--9' as pages, {DOI_SQL} as doi from r where author like '%,%' and author not like '%,' and author not like '{{%'",
    }
    return {k: with_records(v) for k, v in with_sql.items()} | {
        "D13_merge_by_global_ids": f"select component, count(*) as n from ({comps}) group by component",
        "P34_cover_page": "select doc_id, doc_id % 9 = 0 or regexp_replace(lower(text), '\\s', '', 'g') like '%downloadedfrom%' as cover_page from documents",
        "A13_citation_network": "select l_partkey as key, 'part ' || cast(l_partkey as string) as title, count(distinct l_orderkey) as n_papers, cast(sum(cast(l_quantity as integer)) as bigint) as n_intext, bool_or(l_returnflag = 'R') as in_sample from lineitem group by l_partkey",
        "A14_reading_statistics": "select l_suppkey as ID, count(distinct l_orderkey) as n_docs, count(*) as intensity from lineitem group by l_suppkey",
        "A29_average_runtime": "select event_type, round(avg(value), 6) as mean_value, count(*) as n from events group by event_type",
        "D11_unmerge_snapshot": "with n as (select conv_id, arg_max(role, turn) as now from conversations group by conv_id) select c.conv_id, max(turn) as turn, arg_max(role, turn) as role from conversations c join n on n.conv_id = c.conv_id where role is distinct from now group by c.conv_id",
        "P35_forward_search": "with c as (select p_partkey from part where p_brand = 'Brand#1'), o as (select distinct l_orderkey from lineitem where l_partkey in (select p_partkey from c)) select l_partkey, count(distinct l_orderkey) as n_citing from lineitem where l_orderkey in (select l_orderkey from o) and l_partkey not in (select p_partkey from c) group by l_partkey",
    }

"""Queries of cleaning, language filter, samples, resumed work and two readers (F23d-f, P21, P36, Q9, S11, S12, T7, W12), with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import cleaning as C
from recordloom.operators.language import fit_profiles
from recordloom.plans.fixtures import records, with_records
from recordloom.plans.scalars import PAGES_SQL
from recordloom.sources import formats

c = F.col


def f23d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are in order with nicknames in parentheses."""
    in_order = c("author").contains(", ") & (F.char_length(F.split_part("author", F.lit(" "), F.lit(1))) != 1)
    return C.format_fields(records(spark, sf_dir).withColumn("author", F.when(in_order, F.concat("author", F.lit(" (Joe)"))))).select("ID", "author", "pages", "language")


def f23e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a booktitle that repeats the journal, papers with a journal that repeats the booktitle."""
    r = records(spark, sf_dir).withColumns({"journal": F.coalesce("journal", F.upper("booktitle")), "booktitle": F.coalesce("booktitle", F.concat(F.lit("In: "), "journal"))})
    return C.drop_redundant_containers(r).select("ID", "journal", "booktitle")


def f23f(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumns({"title": F.concat(F.lit("<b>A</b>  &amp; "), F.coalesce("title", F.lit(""))), "date": F.concat(F.lit("May 2019 / "), "ID")})
    return C.clean_characters(C.impute_year(r)).select("ID", "title", "author", "year")


def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("title", F.when(c("ENTRYTYPE") == "online", F.concat("title", F.lit(" [der Titel und die Arbeit]"))).otherwise(c("title")))
    return C.language_filter(r, fit_profiles(r.filter(c("language").rlike("^[a-z]{3}$")).select(c("language").alias("lang"), c("abstract").alias("text"))))


def p36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers, their parts as works cited as often as they were bought; parts of one brand are known."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("paper"), c("l_partkey").alias("key"), c("l_quantity").cast("int").alias("n_intext"))
    known = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_brand = 'Brand#1'").select(c("p_partkey").alias("key"))
    return C.backward_candidates(li, known, min_intext=20, min_citing=5)


def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against the first record of their DOI."""
    r = records(spark, sf_dir)
    first = r.withColumn("doi", T.normalise_doi(c("doi"))).filter("doi is not null").groupBy("doi").agg(*(F.min_by(f, "seq").alias(f) for f in ("author", "title", "journal")))
    return C.doi_metadata_defects(r, first)


def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as nbib texts and read again."""
    line = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"{tag.ljust(4)}- "), v))
    text = F.array_join(F.array_compact(F.array(line("PMID", c("ID")), line("TI", F.concat(F.lit("On "), "ID")), line("JT", c("journal")), line("VI", c("volume")), line("IP", c("number")), line("PT", F.lit("Journal Article")))), "\n")
    got = formats.read_nbib(records(spark, sf_dir).filter("journal is not null").select(c("ID").alias("source"), text.alias("content")))
    return formats.standard_columns(got, ["title", "journal", "volume", "number"]).select("local_id", "ENTRYTYPE", "title", "journal", "volume", "number")


def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"%{tag} "), v))
    text = F.array_join(F.array_compact(F.array(line("0", F.lit("Journal Article")), line("T", F.concat(F.lit("On "), "ID")), line("V", c("volume")), line("N", c("number")))), "\n")
    got = formats.read_enl(records(spark, sf_dir).filter("journal is not null").select(c("ID").alias("source"), text.alias("content")))
    return formats.standard_columns(got, ["title", "volume", "number"]).select("source", "ENTRYTYPE", "title", "volume", "number")


def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of records, those of the processed ones made before the interruption."""
    r = records(spark, sf_dir)
    keys = lambda df, when: df.select("ID", T.origin_prefix(c("origins")).alias("source"), F.lit(when).alias("made"))
    return C.resume(r, keys(r.filter("processed"), "before"), lambda rest: keys(rest, "now"))


def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.random_sample(records(spark, sf_dir), 100).select("ID", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "F23d_format_fields": f23d, "F23e_redundant_containers": f23e, "F23f_clean_characters": f23f, "P21_language_filter": p21, "P36_backward_search": p36, "Q9_doi_metadata": q9, "S11_nbib_round_trip": s11, "S12_enl_round_trip": s12,
        "T7_resumed": t7, "W12_random_sample": w12,
    }


def oracle_sql() -> dict[str, str]:
    # trigrams of the texts of a table x (k, text), as a table of k, gram, n
    grams = lambda x: f"(select k, substr(' ' || w || ' ', i, 3) as gram, sum(m) as n from (select k, w, m, unnest(range(1, length(w) + 1)) as i from (select k, w, count(*) as m from (select k, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from {x}) where length(w) <= 40 group by all)) group by all)"
    weight = lambda n: f"cast(round(1000 * ln(({n} + 1) / (total + kinds))) as bigint)"
    known = "(title is not null and title not in ('', 'UNKNOWN'))"
    clean = lambda v: f"regexp_replace(regexp_replace({v}, '\\s+', ' ', 'g'), '<.*?>', '', 'g')"
    return {k: with_records(v) for k, v in {
        "F23f_clean_characters": f"select ID, {clean("'<b>A</b>  &amp; ' || coalesce(title, '')")} as title, {clean('author')} as author, coalesce(year, '2019') as year from r",
        "P21_language_filter": f"""with p as (select language as k, abstract as text from r where regexp_matches(language, '^[a-z]{{3}}$') and abstract is not null), pk as (select * from p where k in (select k from p group by k having count(*) >= 20)),
            g as materialized (select * from {grams('pk')}), tot as (select k, sum(n) as total, (select count(distinct gram) from g) as kinds from g group by k),
            pg as materialized (select g.k as lang, gram, n, {weight('n')} as weight from g join tot using (k)), lg as (select k as lang, {weight('0')} as absent, u.usual from tot join (select lang, floor(sum(n * weight) / sum(n)) as usual from pg group by lang) u on u.lang = k),
            s0 as (select ID, language, case when ENTRYTYPE = 'online' then title || ' [der Titel und die Arbeit]' else title end as title from r), s as (select *, regexp_matches(title, '^.+\\[.+\\]\\s*$') as two from s0),
            u as (select *, case when two then trim(regexp_extract(title, '^(.+?)\\s*\\[(.+)\\]\\s*$', 1)) else title end as a, case when two then regexp_extract(title, '^(.+?)\\s*\\[(.+)\\]\\s*$', 2) end as b from s),
            tx as (select ID || '/1' as k, a as text from u where a is not null union all select ID || '/2', b from u where b is not null), tg as materialized (select * from {grams('tx')}), nn as (select k, sum(n) as n from tg group by k),
            sc as (select tg.k, pg.lang, sum(tg.n * pg.weight) as s, sum(tg.n) as known from tg join pg using (gram) group by all), sd as (select sc.k, sc.lang, sc.known, nn.n, lg.usual, s + (nn.n - known) * absent as score from sc join nn using (k) join lg using (lang)),
            be as (select *, row_number() over (partition by k order by score desc, lang) as place from sd), told as (select k, lang from be where place = 1 and n >= 10 and 100 * known >= 60 * n and score >= n * (usual - 1000)),
            v as (select u.*, t2.lang as l2, case when not {known} then null when language in ('eng') then language when length(title) < 30 then 'eng' else t1.lang end as l from u left join told t1 on t1.k = u.ID || '/1' left join told t2 on t2.k = u.ID || '/2')
            select ID, a as title, case when two then coalesce(l2, 'und') || '=' || b end as other_title, l as language, case when not {known} or l in ('eng') then 'kept' when l is null then 'manual' else 'excluded' end as verdict from v""",
        "S11_nbib_round_trip": "select ID as local_id, 'article' as ENTRYTYPE, 'On ' || ID as title, journal, volume, number from r where journal is not null",
        "S12_enl_round_trip": "select ID as source, 'article' as ENTRYTYPE, 'On ' || ID as title, volume, number from r where journal is not null",
        "T7_resumed": "select ID, split_part(origins, '/', 1) as source, case when processed then 'before' else 'now' end as made from r",
        "W12_random_sample": "select ID, status from r order by md5(ID || '/1'), ID limit 100",
        "F23d_format_fields": f"select ID, case when author is null then null when author like '%, %' and length(split_part(author, ' ', 1)) <> 1 then rtrim(replace(author || ' ', '  ', ' ')) end as author, {PAGES_SQL} as pages, case when regexp_matches(language, '^[a-z]{{3}}$') then language end as language from r",
    }.items()} | {
        "P36_backward_search": "with s as (select l_orderkey, l_partkey from lineitem group by 1, 2 having sum(cast(l_quantity as integer)) >= 20) select l_partkey as key, count(*) as n_citing from s where l_partkey not in (select p_partkey from part where p_brand = 'Brand#1') group by 1 having count(*) >= 5",
    }

"""Feed, sink and source queries (T*, K*, S4, S18), with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.fixtures import records, with_records
from recordloom.session import shared_dir
from recordloom.sources import detect, formats
from recordloom.streaming import feed, keyed

c = F.col
#: all of a record's authors as "Last, First"
WHOLE_NAMES = r"^[A-Z][\p{Ll}]+, [A-Z][\p{Ll}]+( and [A-Z][\p{Ll}]+, [A-Z][\p{Ll}]+)*$"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")


def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of events merged into the state of each user."""
    e = _events(spark, sf_dir)
    first = feed.latest(e.filter("event_id % 2 = 0"), "user_id", "event_id")
    return feed.upsert(first, e.filter("event_id % 2 = 1"), "user_id", "event_id")


def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    first = feed.latest(e.filter("event_id % 2 = 0"), "user_id", "event_id")
    return feed.upsert(first, e.filter("event_id % 2 = 1"), "user_id", "event_id", time_variant=["value"], update_only=True)


def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    new = r.withColumns({
        "title": F.when(c("seq") % 17 == 0, F.concat(F.lit("RETRACTED: "), "title")).otherwise(c("title")),
        "year": F.when((c("year") == "forthcoming") & (c("seq") % 2 == 0), "2024").otherwise(c("year")),
        "volume": F.when(c("seq") % 13 == 0, "99").otherwise(c("volume")), "number": F.when(c("seq") % 13 == 0, "1").otherwise(c("number")),
    })
    return feed.classify(r.filter("seq % 10 <> 1"), new, "ID", ["title", "year", "volume", "number"])


def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into keyed state, drained: the last event of each user out of the log of changes."""
    where = f"{shared_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the table may be one file or a folder of files
    base, _, name = f"{sf_dir}/events.parquet".rpartition("/")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{base}/{name}*")
    keyed.append_log(keyed.feed_changes(stream, "user_id", "event_id", ["event_type"]), f"{where}/log", f"{where}/state").awaitTermination()
    return keyed.latest_of_log(spark, f"{where}/log", "user_id", "event_id").select("user_id", "event_id", "event_type")


def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's files as a stream: a second export repeats the processed records, books with another title."""
    where = f"{shared_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    r = records(spark, sf_dir).select(F.split_part("origins", F.lit("/"), F.lit(1)).alias("source"), c("ID").alias("local_id"), "title", "year", "ENTRYTYPE", "processed")
    first = r.withColumn("export", F.lit("1"))
    second = r.filter("processed").withColumns({"title": F.when(c("ENTRYTYPE") == "book", F.concat(F.coalesce("title", F.lit("")), F.lit(" (2nd)"))).otherwise(c("title")), "export": F.lit("2")})
    for part in (first, second):
        part.drop("ENTRYTYPE", "processed").write.mode("append").partitionBy("export").parquet(f"{where}/in")
    stream = spark.readStream.schema("source string, local_id string, title string, year string, export string").parquet(f"{where}/in").withColumn("_file", c("export"))
    keyed.append_log(keyed.append_only_changes(stream, ["title", "year"]), f"{where}/log", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/log").groupBy("change").agg(F.sum("n").alias("n"))


def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "1 day")


def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", formats.bib_text(["author", "journal", "title", "year", "doi"]).alias("text"))


def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", formats.ris_text().alias("text"))


def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ID", formats.markdown_row(["author", "title", "year", "journal"]).alias("text"))


def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("ID", "seq", "title", "year")
    changed = r.filter("seq % 5 = 0").withColumn("year", F.lit("1900")).unionAll(spark.createDataFrame([("X1", -1, "new", "2000")], "ID string, seq long, title string, year string"))
    return formats.merge_by_id(r, changed)


def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as BibTeX texts and read again."""
    texts = records(spark, sf_dir).select(c("ID").alias("source"), formats.bib_text(["author", "title", "year", "doi"]).alias("content"))
    return formats.standard_columns(formats.read_bib(texts), ["author", "title", "year", "doi"]).select(c("local_id").alias("ID"), "ENTRYTYPE", "author", "year", "doi")


def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as RIS texts and read again."""
    texts = records(spark, sf_dir).filter("journal is not null").select(c("ID").alias("source"), formats.ris_text().alias("content"))
    return formats.standard_columns(formats.read_ris(texts), ["author", "year", "journal", "volume", "doi"]).select(c("source").alias("ID"), "author", "year", "journal", "volume", "doi")


def _written(records: DataFrame, text: Column, suffix: str) -> str:
    """Record texts as files in the shared folder: where they are."""
    path = f"{shared_dir(records.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}.{suffix}"
    formats.write_text(records, text, path)
    return path


def s5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to BibTeX files, which are read in byte ranges."""
    r = records(spark, sf_dir)
    got = formats.load(spark, _written(r, formats.bib_text(["author", "title", "year", "doi"]), "bib"))
    return formats.standard_columns(got, ["author", "title", "year", "doi"]).select(c("local_id").alias("ID"), "ENTRYTYPE", "author", "year", "doi")


def s10_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to RIS files, which are read in byte ranges."""
    r = records(spark, sf_dir).filter("journal is not null")
    text = F.concat(F.lit("TY  - JOUR\nID  - "), "ID", F.lit("\n"), F.regexp_replace(formats.ris_text(), "^TY.*\n", ""), F.lit("\n"))
    got = formats.load(spark, _written(r, text, "ris"))
    return formats.standard_columns(got, ["author", "year", "journal", "volume", "doi"]).select(c("local_id").alias("ID"), "author", "year", "journal", "volume", "doi")


def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by authors with whole names as a list of citation texts, read again."""
    r = records(spark, sf_dir).filter("journal is not null and volume is not null and volume <> 'UNKNOWN'").filter(c("author").rlike(WHOLE_NAMES) & c("year").rlike("^[0-9]{4}$"))
    short = F.array_join(F.transform(F.split("author", " and "), lambda n: F.concat(F.split_part(n, F.lit(", "), F.lit(1)), F.lit(" "), F.substring(F.split_part(n, F.lit(", "), F.lit(2)), 1, 1))), ", ")
    text = F.concat(short, F.lit(" ("), "year", F.lit(") On the making of record "), "ID", F.lit(". "), F.initcap("journal"), F.lit(" "), "volume", F.when(c("number").isNotNull(), F.concat(F.lit("("), "number", F.lit(")"))).otherwise(""), F.lit(": 11–19."))
    got = formats.load(spark, _written(r, text, "md"))
    fields = formats.standard_columns(got, ["author", "year", "title", "journal", "volume", "number", "pages"])
    return fields.select(F.regexp_extract("title", "R[0-9]+$", 0).alias("ID"), "ENTRYTYPE", "author", "year", "title", "journal", "volume", "number", "pages")


def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = records(spark, sf_dir).select(F.concat(F.lit("f"), (c("seq") % 5).cast("string")).alias("source"), formats.bib_text(["title", "year"]).alias("content"))
    return formats.count_records(texts, "bib")


def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    mark = F.when(c("seq") % 4 == 0, "source={Scopus},").when(c("seq") % 4 == 1, "Date Added To Xplore").when(c("seq") % 4 == 2, "Unique-ID = {1}").otherwise("nothing")
    return detect.detect(r.select(F.concat("ID", F.lit(".bib")).alias("source"), mark.alias("content")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "T1_feed_upsert": t1, "T2_time_variant": t2, "T4_change_classes": t4, "T8_append_only_stream": t8, "T9_stream_latest": t9, "T10_windowed_counts": t10, "K1_bib": k1, "K2_markdown": k2, "K3_ris": k3, "K5_partial_save": k5,
        "S4_count_records": s4, "S5_bib_round_trip": s5, "S5_bib_files": s5_files, "S10_ris_files": s10_files, "S15_reference_lists": s15, "S10_ris_round_trip": s10, "S18_detect_source": s18,
    }


def oracle_sql() -> dict[str, str]:
    last = lambda cond: f"select * from (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by event_id desc) as n from events where {cond}) where n = 1"
    bib = lambda fields: "'@' || ENTRYTYPE || '{' || ID || ',' || chr(10) || array_to_string(list_filter([" + ", ".join(f"case when {f} is not null and {f} <> '' then '   {f.ljust(28)} = {{' || {f} || '}}' end" for f in fields) + "], lambda x: x is not null), ',' || chr(10)) || ',' || chr(10) || '}' || chr(10)"
    known = lambda f: f"{f} is not null and {f} not in ('', 'UNKNOWN')"
    one = lambda tag, v, cond: f"case when {cond} then ['{tag}  - ' || {v}] else [] end"
    kinds = "case ENTRYTYPE when 'article' then 'JOUR' when 'inproceedings' then 'CONF' when 'book' then 'BOOK' when 'inbook' then 'CHAP' when 'techreport' then 'RPRT' when 'phdthesis' then 'THES' else 'GEN' end"
    ris = "array_to_string(flatten([['TY  - ' || " + kinds + "], case when " + known("author") + " then list_transform(string_split(author, ' and '), lambda a: 'AU  - ' || a) else [] end, " + ", ".join([
        one("TI", "title", known("title")), one("PY", "year", known("year")), one("JO", "journal", known("journal")), one("T2", "booktitle", known("booktitle")), one("VL", "volume", known("volume")), one("IS", "number", known("number")),
        one("SP", "split_part(pages, '--', 1)", known("pages")), one("EP", "split_part(pages, '--', 2)", known("pages") + " and pages like '%--%'"), one("DO", "doi", known("doi")), one("UR", "url", known("url")), "['ER  - ']",
    ]) + "]), chr(10))"
    return {
        "T1_feed_upsert": f"select user_id, event_id, event_type, value from ({last('true')})",
        "T2_time_variant": f"with a as ({last('event_id % 2 = 0')}), b as ({last('true')}) select b.user_id, b.event_id, b.event_type, case when a.user_id is not null then a.value else b.value end as value from b left join a on a.user_id = b.user_id",
        "T9_stream_latest": f"select user_id, event_id, event_type from ({last('true')})",
        "T10_windowed_counts": "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events group by 1, 2",
    } | {k: with_records(v) for k, v in {
        "S15_reference_lists": f"""select ID, 'article' as ENTRYTYPE, array_to_string(list_transform(string_split(author, ' and '), lambda n: split_part(n, ', ', 1) || ', ' || substr(split_part(n, ', ', 2), 1, 1)), ' and ') as author, year, 'On the making of record ' || ID as title,
            array_to_string(list_transform(string_split(journal, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as journal, volume, number, '11--19' as pages from r
            where journal is not null and volume is not null and volume <> 'UNKNOWN' and regexp_matches(author, '{WHOLE_NAMES}') and regexp_matches(year, '^[0-9]{{4}}$')""",
        "T8_append_only_stream": "select * from (select 'added' as change, count(*) as n from r union all select 'repeated', count(*) from r where processed and ENTRYTYPE <> 'book' union all select 'violation', count(*) from r where processed and ENTRYTYPE = 'book') where n > 0",
        "T4_change_classes": """with n as (select ID, seq, case when seq % 17 = 0 then 'RETRACTED: ' || title else title end as title, case when year = 'forthcoming' and seq % 2 = 0 then '2024' else year end as year,
            case when seq % 13 = 0 then '99' else volume end as volume, case when seq % 13 = 0 then '1' else number end as number from r), o as (select * from r where seq % 10 <> 1)
            select n.ID, case when o.ID is null then 'added' when o.title is not distinct from n.title and o.year is not distinct from n.year and o.volume is not distinct from n.volume and o.number is not distinct from n.number then 'same'
              when starts_with(n.title, 'RETRACTED') and not starts_with(o.title, 'RETRACTED') then 'retracted'
              when (o.year = 'forthcoming' and n.year <> 'forthcoming') or (o.volume is null and o.number is null and n.volume is not null and n.number is not null) then 'published' else 'changed' end as change
            from n left join o on o.ID = n.ID""",
        "K1_bib": f"select ID, {bib(['author', 'journal', 'title', 'year', 'doi'])} as text from r",
        "K2_markdown": "select ID, '| ' || coalesce(replace(author, '|', '\\|'), '') || ' | ' || coalesce(replace(title, '|', '\\|'), '') || ' | ' || coalesce(year, '') || ' | ' || coalesce(journal, '') || ' |' as text from r",
        "K3_ris": f"select ID, {ris} as text from r",
        "K5_partial_save": "select ID, seq, title, case when seq % 5 = 0 then '1900' else year end as year from r union all select 'X1', -1, 'new', '2000'",
        "S4_count_records": "select 'f' || cast(seq % 5 as string) as source, count(*) as n from r group by 1",
        "S5_bib_round_trip": "select ID, ENTRYTYPE, author, year, doi from r",
        "S5_bib_files": "select ID, ENTRYTYPE, author, year, doi from r",
        "S10_ris_files": "select ID, nullif(author, 'UNKNOWN') as author, nullif(year, 'UNKNOWN') as year, journal, nullif(volume, 'UNKNOWN') as volume, nullif(doi, 'UNKNOWN') as doi from r where journal is not null",
        "S10_ris_round_trip": "select ID, nullif(author, 'UNKNOWN') as author, nullif(year, 'UNKNOWN') as year, journal, nullif(volume, 'UNKNOWN') as volume, doi from r where journal is not null",
        "S18_detect_source": """with d as (select ID || '.bib' as source, unnest(case seq % 4 when 0 then [struct_pack(database := 'scopus', confidence := 1.0::double)] when 1 then [struct_pack(database := 'ieee', confidence := 0.9::double), struct_pack(database := 'unknown_source', confidence := 0.1::double)]
            when 2 then [struct_pack(database := 'web_of_science', confidence := 0.7::double), struct_pack(database := 'unknown_source', confidence := 0.1::double)] else [struct_pack(database := 'unknown_source', confidence := 0.1::double)] end) as d from r)
            select source, d.database as database, d.confidence as confidence, row_number() over (partition by source order by d.confidence desc) as place from d""",
    }.items()}

"""Items of further catalogues as records (X2, X4, X5, X6, X8), with DuckDB SQL: records written as items and transformed back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.fixtures import records, with_records
from recordloom.sources import items

c = F.col


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose authors have a last and a first name each."""
    return records(spark, sf_dir).filter("title is not null and author like '%,%' and author not like '%,' and author not like '{%' and author not like '%, and %'")


def _people() -> Column:
    """Names as they are spoken."""
    return F.transform(F.split("author", " and "), lambda n: F.trim(F.concat(F.trim(F.split_part(n, F.lit(","), F.lit(2))), F.lit(" "), F.trim(F.split_part(n, F.lit(","), F.lit(1))))))


def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("ENTRYTYPE") == "article", "JournalArticle").when(c("ENTRYTYPE") == "inproceedings", "Conference").when(c("ENTRYTYPE") == "book", "Book").otherwise("Dataset")
    item = F.to_json(F.struct(
        c("ID").alias("paperId"), "title", "year", F.coalesce("journal", "booktitle").alias("venue"), c("cited_by").alias("citationCount"), F.array(kind).alias("publicationTypes"), F.transform(_people(), lambda n: F.struct(n.alias("name"))).alias("authors"),
        F.struct(F.lower("doi").alias("DOI")).alias("externalIds"), F.when(c("journal").isNotNull(), F.struct(c("journal").alias("name"), "volume", F.replace("pages", F.lit("--"), F.lit("-")).alias("pages"))).alias("journal"),
    ))
    return items.papers(_named(spark, sf_dir).select(item.alias("item"))).select("local_id", "ENTRYTYPE", "title", "author", "year", "journal", "booktitle", "volume", "pages", "doi", "cited_by")


def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("ENTRYTYPE") == "article", "Journal Articles").when(c("ENTRYTYPE") == "inproceedings", "Conference and Workshop Papers").otherwise("Editorship")
    item = F.to_json(F.struct(
        F.concat("title", F.lit(".")).alias("title"), F.struct(F.transform(_people(), lambda n: F.struct(n.alias("text"))).alias("author")).alias("authors"), F.coalesce("journal", "booktitle").alias("venue"), "year", kind.alias("type"), c("ID").alias("key"), "doi", c("url").alias("ee"), "volume", "number",
    ))
    return items.bibliography_entries(_named(spark, sf_dir).select(item.alias("item")))


def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"<{name}>"), F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</{name}>"))).otherwise("")
    people = F.array_join(F.transform(F.split("author", " and "), lambda n: F.concat(F.lit("<Author>"), tag("LastName", F.trim(F.split_part(n, F.lit(","), F.lit(1)))), tag("ForeName", F.trim(F.split_part(n, F.lit(","), F.lit(2)))), F.lit("</Author>"))), "")
    item = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><Article>"), tag("ArticleTitle", F.concat(F.lit("["), "plain", F.lit("]."))), F.lit("<AuthorList>"), people, F.lit("</AuthorList><Journal>"), tag("ISOAbbreviation", c("journal")),
        F.lit("<JournalIssue>"), tag("Volume", c("volume")), tag("Issue", c("number")), F.lit("<PubDate>"), tag("Year", c("year")), F.lit('</PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">'),
        c("ID"), F.lit('</ArticleId><ArticleId IdType="pii">x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'),
    )
    # letters, digits and blanks: XML can't carry all characters of a text
    plain = F.concat(F.lit("T "), F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}& <]", "")))
    return items.citations(_named(spark, sf_dir).withColumn("plain", plain).select(item.alias("item"))).select("pubmedid", "ENTRYTYPE", "title", "author", "year", "journal", "volume", "number")


def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.to_json(F.struct(
        F.concat(F.lit("SCOPUS_ID:"), "ID").alias("dc:identifier"), c("title").alias("dc:title"), F.replace("author", F.lit(" and "), F.lit(";")).alias("dc:creator"), F.coalesce("journal", "booktitle").alias("prism:publicationName"), c("volume").alias("prism:volume"),
        c("number").alias("prism:issueIdentifier"), c("pages").alias("prism:pageRange"), F.concat("year", F.lit("-01-01")).alias("prism:coverDate"), c("doi").alias("prism:doi"), F.when(c("ENTRYTYPE") == "book", "bk").alias("subtype"),
        F.when(c("ENTRYTYPE") == "article", "Journal").when(c("ENTRYTYPE") == "inproceedings", "Conference Proceeding").alias("prism:aggregationType"), F.concat(F.lit("["), "isbn", F.lit("]")).alias("prism:isbn"),
    ))
    return items.abstracts(records(spark, sf_dir).select(item.alias("item"))).select("local_id", "ENTRYTYPE", "title", "author", "year", "journal", "booktitle", "volume", "number", "isbn")


def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(c("cited_by") == "7", F.concat(F.lit("(Retracted) "), "title")).otherwise(c("title"))
    item = F.to_json(F.struct(c("ID").alias("id"), title.alias("title_display"), _people().alias("author_display"), "journal", "volume", c("number").alias("issue"), F.concat("year", F.lit("-05-01T00:00:00Z")).alias("publication_date"), F.array("abstract").alias("abstract")))
    return items.articles(_named(spark, sf_dir).select(item.alias("item"))).select("doi", "title", "author", "year", "journal", "volume", "number", F.md5(F.coalesce("abstract", F.lit("")).cast("binary")).alias("abstract_md5"), "retracted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"X2_papers": x2, "X4_bibliography_entries": x4, "X5_citations": x5, "X6_abstracts": x6, "X8_articles": x8}


def oracle_sql() -> dict[str, str]:
    named = "n as (select * from r where title is not null and author like '%,%' and author not like '%,' and author not like '{%' and author not like '%, and %')"
    people = "list_transform(string_split(author, ' and '), lambda x: string_split_regex(trim(trim(split_part(x, ',', 2)) || ' ' || trim(split_part(x, ',', 1))), ' +'))"
    last = f"array_to_string(list_transform({people}, lambda w: case when len(w) > 1 then w[len(w)] || ', ' || array_to_string(w[1:len(w) - 1], ' ') else w[1] end), ' and ')"
    particle = f"array_to_string(list_transform({people}, lambda w: case when len(w) > 2 and lower(w[len(w) - 1]) in ({', '.join(repr(x) for x in items.PARTICLES)}) then '{{' || w[len(w) - 1] || ' ' || w[len(w)] || '}}, ' || array_to_string(w[1:len(w) - 2], ' ') when len(w) > 1 then w[len(w)] || ', ' || array_to_string(w[1:len(w) - 1], ' ') else w[1] end), ' and ')"
    p, single = "regexp_replace(replace(pages, '--', '-'), '\\s+|[a-zA-Z]+', '', 'g')", "replace(pages, '--', '-')"
    num = lambda i: f"try_cast(regexp_extract({p}, '^([0-9]+)-([0-9]+)', {i}) as bigint)"
    pages = f"case when {single} not like '%-%' then {single} when {num(1)} is not null and {num(2)} is not null then case when {num(1)} = {num(2)} then cast({num(1)} as string) else cast(least({num(1)}, {num(2)}) as string) || '--' || cast(greatest({num(1)}, {num(2)}) as string) end else {p} end"
    kind = "case when ENTRYTYPE in ('article', 'inproceedings', 'book') then ENTRYTYPE when journal is not null then 'article' else 'misc' end"
    return {k: with_records(v) for k, v in {
        "X2_papers": f"with {named}, k as (select *, {kind} as kind from n) select ID as local_id, kind as ENTRYTYPE, title, {last} as author, year, case when kind = 'article' then coalesce(journal, booktitle) end as journal, case when kind = 'inproceedings' then coalesce(journal, booktitle) end as booktitle, case when kind = 'article' and journal is not null then volume end as volume, case when kind = 'article' and journal is not null then {pages} end as pages, upper(doi) as doi, cited_by from k",
        "X4_bibliography_entries": f"with {named}, k as (select *, case when ENTRYTYPE in ('article', 'inproceedings') then ENTRYTYPE else 'misc' end as kind from n) select 'https://dblp.org/rec/' || ID as dblp_key, kind as ENTRYTYPE, translate(trim(regexp_replace(regexp_replace(title || '.', '\\.+$', ''), '\\s+', ' ', 'g')), '{{}}', '') as title, translate({last}, '{{}}', '') as author, year, case when kind = 'article' then coalesce(journal, booktitle) end as journal, case when kind = 'inproceedings' then coalesce(journal, booktitle) end as booktitle, volume, number, upper(doi) as doi, url from k",
        "X5_citations": f"with {named} select ID as pubmedid, case when journal is not null then 'article' else 'misc' end as ENTRYTYPE, 'T ' || trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}}& <]', '', 'g')) as title, array_to_string(list_transform(string_split(author, ' and '), lambda x: trim(split_part(x, ',', 1)) || ', ' || trim(split_part(x, ',', 2))), ' and ') as author, year, journal, volume, number from n",
        "X6_abstracts": "with k as (select *, case when ENTRYTYPE = 'book' then 'book' when ENTRYTYPE = 'article' then 'article' when ENTRYTYPE = 'inproceedings' or isbn is not null then 'inproceedings' else 'misc' end as kind from r) select ID as local_id, kind as ENTRYTYPE, title, author, substr(year || '-01-01', 1, 4) as year, case when kind = 'article' then coalesce(journal, booktitle) end as journal, case when kind = 'inproceedings' then coalesce(journal, booktitle) end as booktitle, volume, number, replace(isbn, ' ', '') as isbn from k",
        "X8_articles": f"with {named} select ID as doi, case when cited_by = '7' then '(Retracted) ' || title else title end as title, {particle} as author, split_part(year || '-05-01', '-', 1) as year, journal, volume, number, md5(coalesce(abstract, '')) as abstract_md5, cited_by = '7' or lower(title) like '%(retracted)%' as retracted from n",
    }.items()}

"""The queries of this subpackage, each (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.decontaminate import leak_report
from recordloom.llm.divergence import source_divergence
from recordloom.llm.html_text import extract_main_text
from recordloom.llm.language_id import document_rows, fit_documents, identify, page_rows
from recordloom.llm.line_rules import clean_lines
from recordloom.llm.nearest import nearest
from recordloom.llm.ngram_join import ngram_components
from recordloom.llm.pack import pack_tokens
from recordloom.llm.phrase_dedup import remove_repeats
from recordloom.llm.shard import histogram_shards
from recordloom.llm.spelling import spelling_variants
from recordloom.llm.token_counts import word_piece_counts
from recordloom.llm.warc_zip import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) by text, declared language and source, and pages (page_id) by text, markup, address and host."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = fit_documents(docs)
    of_docs = identify(document_rows(docs), model, ["doc_id"])
    of_pages = identify(page_rows(pages), model, ["page_id"])
    none = F.lit(None).cast("long")
    return of_docs.select("doc_id", none.alias("page_id"), "lang", "confidence", "rejected").unionAll(of_pages.select(none.alias("doc_id"), "page_id", "lang", "confidence", "rejected"))


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = histogram_shards(docs, shards=8, with_text=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"), with_ids=False)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_archives(_table(spark, sf_dir, "pages"))
    return read_archives(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op10_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_piece_counts(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(_table(spark, sf_dir, "documents"), with_text=False).drop("n_lines", "n_removed", "lost_words")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_language_id": op3_language_id,
        "op4_histogram_sharding": op4_histogram_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_packing": op7_packing,
        "op8_warc_zip": op8_warc_zip,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_word_piece_counts": op10_word_piece_counts,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_line_rules": op12_line_rules,
        "op13_source_divergence": op13_source_divergence,
    }


NEAREST_SQL = """
with v as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
    select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score
    from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

WARC_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
b as (select page_id, strlen(payload) as n, sha1(payload) as digest from p),
k as (select digest, max(page_id) as keep from b where n >= 1000 group by digest)
select b.page_id, cast(n as bigint) as payload_bytes, b.digest as payload_digest,
       case when b.page_id < k.keep then 'revisit' else 'response' end as record_type,
       case when b.page_id < k.keep then k.keep end as refers_to
from b left join k on b.digest = k.digest and b.n >= 1000
"""


LINES_SQL = r"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as lines from d),
g as (select k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s, i from (select k, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select k, count(distinct p) as n from (select k, i, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by k, s) as m from g) where m > 1) group by k),
l as (select k, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b from w),
p as (select k, b, length(b) as chars, len(regexp_split_to_array(b, '[ \t-\r]+')) as words, len(regexp_split_to_array(b, '[ \t]+[|»›•·→>/\\]+[ \t]+')) as items, len(regexp_split_to_array(b, '[!?]{2,}')) - 1 as runs,
        length(regexp_replace(b, '[ \t-\r\p{L}\p{N}\p{M}]+', '', 'g')) as marks from l),
x as (select k, sum(words) as words from p where items >= 3 and words - (items - 1) <= 3 * items
    or chars <= 40 and regexp_matches(b, '(?i)^(home|menu|search|next|previous|prev|back|top|skip to [a-z ]+|read more|more|click here|share|print|reply|log ?in|sign ?(in|up|out)|register|contact( us)?|about( us)?|sitemap|[<«‹]+.*|.*[>»›]+)$')
    or chars <= 240 and regexp_matches(b, '(?i)(^|[^a-zA-Z])(all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|copyright *[0-9]{4}|licen[sc]ed under|released under|terms of (use|service)|privacy policy|cookie|enable javascript|powered by|lorem ipsum|subscribe to|newsletter|spdx-license|© *[0-9]{4}|\(c\) *[0-9]{4})')
    or marks > 0.3 * chars or runs >= 3 and runs * 3 >= words or chars < 20 and words < 3 and not regexp_matches(b, '[.!?:;,…。！？：；،؟।"''”’»)\]]$') group by k),
c as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(r.n, 0) as n_repeat_words, coalesce(x.words, 0) as lost from w left join r using (k) left join x using (k))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.3::double * n_words as kept from c
"""

DIVERGENCE_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
g as (select distinct lang, source from d),
v as (select lang, term, count(*) as n from t group by lang, term having count(distinct k) >= 10),
l as (select lang, count(*) as v, sum(n) as n from v group by lang),
x as (select t.lang, t.source, t.term, count(*) as n from t join v on t.lang = v.lang and t.term = v.term group by all),
s as (select lang, source, sum(n) as n from x group by all),
p as (select g.lang, g.source, v.term, coalesce(x.n, 0) as n,
        cast(1 + (1000000000::hugeint * (coalesce(x.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) as bigint) as p, cast(1 + (1000000000::hugeint * (v.n + 2)) // (l.n + 2 * l.v) as bigint) as q
      from g join v on g.lang = v.lang join l on l.lang = g.lang left join s on s.lang = g.lang and s.source = g.source left join x on x.lang = g.lang and x.source = g.source and x.term = v.term),
f as (select a.lang, a.source, b.source as item, cast(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value, cast(rank as integer) as rank from o where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest_neighbours": NEAREST_SQL, "op8_warc_zip": WARC_SQL, "op12_line_rules": LINES_SQL, "op13_source_divergence": DIVERGENCE_SQL}

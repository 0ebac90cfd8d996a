"""Records made of the driver's ``documents``: one mapping in SQL that both Spark and DuckDB read.

The mapping is data, not an operator: it spreads the defects, types and states that the operators look for over the
documents by their number. A title is a text's whole first line, an abstract the whole text. Two in a hundred records share all fields with one before (base).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.functions.text import upper_sql
from recordloom.schema import POST, STATES

_PROCESSED = ", ".join(str(i) for i, s in enumerate(STATES[1:]) if s in POST["md_processed"])
_STATE = " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATES[1:]))

RECORDS = f"""
select
  'R' || lpad(cast(doc_id as string), 7, '0') as ID, doc_id as seq,
  case when k = 52 then 'inbook' when k = 53 then 'proceedings' else case k % 10 when 0 then 'inproceedings' when 1 then 'book' when 2 then 'phdthesis' when 3 then 'misc' when 4 then 'online' when 5 then 'inproceedings' else 'article' end end as ENTRYTYPE,
  case k when 7 then case when lang = 'en' then upper(head) else head end when 11 then 'doi:10.1000/' || cast(doc_id as string) when 13 then head || '...' when 17 then '12345 678 90'
    when 19 then null when 23 then 'UNKNOWN' when 29 then head || ' - Research Paper' when 36 then 'The Journal of src' || cast(cast(floor(doc_id / 7) as bigint) % 11 as string) when 37 then 'Study_of.things2' when 38 then 'Editorial' else head end as title,
  case k when 5 then null when 8 then 'UNKNOWN' when 14 then '{{{{Open Source Group}}}}' when 21 then 'Smith, John and others' when 26 then 'SMITH, JOHN AND LEE, KIM' when 33 then 'Jones, Ann, and Lee, K.'
    when 34 then 'von Berg, Max and Lee, K. von' when 39 then 'University of Harvard' when 44 then 'Dr Smith, John' when 47 then 'Meyer,' when 51 then 'smith, john'
    else case base % 7 when 0 then 'Müller, Anna' when 1 then 'van Dyke, J. P.' when 2 then 'O''Neil, Sean' when 3 then 'Garcia, José' when 4 then 'Tanaka, Yuki' when 5 then 'Lee, K.' else 'Brown, Tom' end
      || case base % 5 when 0 then '' when 1 then ' and Rossi, Carla' when 2 then ' and Kim, Min and Ng, Wei' when 3 then ' and Ng, Wei and Kim, Min and Rossi, Carla' else ' and Ng, Wei' end end as author,
  case when k = 16 then null when k = 18 then 'UNKNOWN' when k % 12 = 0 then 'forthcoming' when k = 27 then '20XX' else cast(1990 + base % 35 as string) end as year,
  case when k % 10 in (6, 7, 8, 9) or k = 15 then case when k = 46 then 'MISQ' when k = 48 then 'Workshop on ' || source when k = 56 then null when k = 59 then 'JOURNAL OF INFORMATION SYSTEMS' else 'Journal of src' || cast(cast(floor(base / 7) as bigint) % 11 as string) end end as journal,
  case when k % 10 in (0, 5) or k = 58 then case when k = 25 then 'Proc. of ' || source when k = 35 then 'Journal of Things' when k = 45 then null else 'Proceedings of the ' || source || ' Conference' end end as booktitle,
  case when k % 10 = 1 then 'Publisher ' || source end as publisher, case when k % 10 = 2 then 'School of ' || source end as school,
  case when k % 10 in (6, 7, 8, 9) and k <> 9 then case when k = 28 then 'UNKNOWN' else cast(base % 7 + 1 as string) end end as volume,
  case when k % 10 in (6, 7, 8) or k = 20 then cast(base % 3 + 1 as string) end as number,
  case k % 8 when 0 then cast(doc_id % 300 + 1 as string) || '--' || cast(doc_id % 300 + 12 as string) when 1 then cast(doc_id % 300 + 50 as string) || '--' || cast(doc_id % 300 + 1 as string)
    when 2 then cast(doc_id % 300 + 100 as string) || '-' || cast(doc_id % 300 + 110 as string) when 3 then '1123--45' when 4 then 'n.pag.' when 5 then 'xi--xx' else null end as pages,
  case when k % 6 = 0 then null when k = 41 then '11.5/abc' when k % 6 = 1 then 'https://doi.org/10.' || cast(1000 + cast(floor(doc_id / 3) as bigint) % 9 as string) || '/rec.' || cast(cast(floor(doc_id / 3) as bigint) as string)
    else '10.' || cast(1000 + cast(floor(doc_id / 3) as bigint) % 9 as string) || '/rec.' || cast(cast(floor(doc_id / 3) as bigint) as string) end as doi,
  case when k % 7 = 0 then 'http://www.' || source || '.org/' || cast(doc_id % 500 as string) when k % 7 = 3 then 'https://www.' || source || '.org/' || cast(doc_id % 500 as string) || '/' end as url,
  case when k % 10 = 1 then case when k = 31 then 'no isbn' when k = 51 then 'ISBN 978-3-16-148410-0' else '9783161484100' end when k = 43 then '9783161484100' end as isbn,
  case when k % 15 = 2 then null when k % 15 = 4 then 'en' when k % 15 = 5 then 'english' when lang = 'en' then 'eng' when lang = 'de' then 'deu' when lang = 'fr' then 'fra' when lang = 'es' then 'spa' else lang end as language,
  case when k = 42 then 'An abstract that stops here...' when k = 49 then 'Caf&#233; and ™ symbols' else text end as abstract,
  'topic' || cast(doc_id % 11 as string) || ', topic' || cast(doc_id % 13 as string) as keywords,
  case when k % 3 = 0 then 'data/pdfs/' || source || '/' || cast(1990 + doc_id % 35 as string) || '/' || cast(doc_id as string) || '.pdf' end as file,
  cast(doc_id % 97 as string) as cited_by, case when k % 20 = 3 then cast(100000 + doc_id as string) when k = 57 then 'PMC12' end as pubmedid,
  case (doc_id * 5) % 14 {_STATE} end as status,
  case when (doc_id * 5) % 14 in (11, 12, 13) then 'c1=' || case when (doc_id * 5) % 14 = 11 or doc_id % 2 = 0 then 'out' else 'in' end || ';c2=in' end as screening_criteria,
  source || '.bib/' || lpad(cast(doc_id as string), 6, '0') || case when k % 9 = 0 then ';md_crossref.bib/' || lpad(cast(doc_id as string), 6, '0') else '' end
    || case when k % 11 in (0, 1) then ';web.bib/' || lpad(cast(cast(floor(doc_id / 2) as bigint) as string), 6, '0') else '' end as origins,
  case when k % 13 = 4 then 'CURATED' end as curated, (doc_id * 5) % 14 in ({_PROCESSED}) as processed, text
from (select doc_id, coalesce(text, '') as text, lang, source, doc_id % 60 as k, split_part(coalesce(text, ''), chr(10), 1) as head,
  doc_id - case when doc_id % 60 = 38 then cast(floor(doc_id / 60) as bigint) % 2 * 60 else 0 end as base from {{documents}}) d
"""

# Spark's upper() makes SS of a sharp s, DuckDB's one capital letter
SPARK_RECORDS = RECORDS.replace("upper(head)", upper_sql("head"))
DUCK_RECORDS = RECORDS.replace("{documents}", "documents").replace("{{", "{").replace("}}", "}")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a table folder."""
    return spark.sql(SPARK_RECORDS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_records(sql: str) -> str:
    """DuckDB SQL over the same records, as a table named r."""
    if sql.startswith("with recursive "):
        return f"with recursive r as ({DUCK_RECORDS}), {sql[15:]}"
    return f"with r as ({DUCK_RECORDS}) {sql}" if not sql.lstrip().lower().startswith("with ") else f"with r as ({DUCK_RECORDS}), {sql.lstrip()[5:]}"

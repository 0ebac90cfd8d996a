"""Text formats of bibliographic records: readers that split files into records and parse them in Arrow tasks, and writers.

A reader returns a row for each record: source, local_id, ENTRYTYPE, fields (map), seq (which rises through a file). ``load`` reads files in byte ranges: the first
line of a record serves as the text source's line separator, so each task takes up at the first record of its range and reads the last one to its end, and a large file
is read and parsed by many tasks. read_bib, read_ris, read_nbib and read_enl take a table (source, content) of whole texts instead.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.citations import parse_reference
from recordloom.sources.workbooks import read_workbooks, save_workbooks, workbooks

RECORD = "source string, seq long, ENTRYTYPE string, local_id string, fields map<string,string>"

# fixed values: tags of the formats and the fields they fill
RIS_FIELDS = {
    "TI": "title", "T1": "title", "AU": "author", "A1": "author", "PY": "year", "Y1": "year", "JO": "journal", "JF": "journal", "T2": "journal", "VL": "volume", "IS": "number", "SP": "start_page",
    "EP": "end_page", "DO": "doi", "UR": "url", "SN": "issn", "AB": "abstract", "N2": "abstract", "KW": "keywords", "PB": "publisher", "LA": "language",
}
RIS_TYPES = {"JOUR": "article", "ABST": "article", "CONF": "inproceedings", "CPAPER": "inproceedings", "BOOK": "book", "CHAP": "inbook", "RPRT": "techreport", "THES": "phdthesis"}
NBIB_FIELDS = {"TI": "title", "AU": "author", "FAU": "author", "DP": "year", "JT": "journal", "VI": "volume", "IP": "number", "PG": "pages", "AB": "abstract", "LA": "language", "AID": "doi", "IS": "issn", "OT": "keywords"}
ENL_FIELDS = {"T": "title", "A": "author", "D": "year", "B": "journal", "J": "journal", "V": "volume", "N": "number", "P": "pages", "U": "url", "X": "abstract", "K": "keywords"}
JOIN = {"author": " and ", "keywords": ", "}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of whole text files. The source is the file's name."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("content"))


#: what stands before each record but a file's first one: the text source's line separator; what a piece must have to be a record, and what isn't one
STARTS = {"bib": ["\n@"], "ris": ["\nTY  - "], "nbib": ["\nPMID- ", "\nOWN - "], "enl": ["\n%0 "]}
PARTS = {"bib": r"(?m)^(?=\s*@)", "ris": r"(?m)^(?=TY  ?- )", "nbib": r"\n\s*\n", "enl": r"\n\s*\n"}
RECORDS = {"bib": r"^@\s*[A-Za-z]+\s*\{", "ris": r"(?m)^TY  ?- .*\n(?s:.*)^[A-Z][A-Z0-9]{1,3} *- ?", "nbib": r"(?m)^TI *- ", "enl": "(?m)^%T "}
NO_RECORDS = r"^@\s*(comment|preamble|string)"


def split_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """source (a file's name), seq, record: the record texts of all files at a path, read in byte ranges.

    Lines end by \\n or \\r\\n. What stands before a file's first record is left out, and a byte order mark is. seq is (start of the range, place in it). Records that begin in another way than the separator
    says (indented, one space in a RIS tag) are cut out of the piece that they are in; a file of such records only is read by one task.
    """
    starts = STARTS[kind]
    if len(starts) > 1:  # the first line tells which
        head = spark.read.text(path).filter("value <> ''").first()
        starts = [s for s in starts if head is not None and head[0].lstrip("\ufeff").startswith(s.strip())] or starts
    tag = starts[0][1:]
    pieces = spark.read.text(path, lineSep=starts[0]).select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n").alias("v"))
    # the separator took a record's tag; a file's first piece still has its own
    whole = F.when(F.col("v").rlike(r"\A\s*" + re.escape(tag.strip()).replace(r"\ ", " *")), F.col("v")).otherwise(F.concat(F.lit(tag), "v"))
    cut = pieces.select("source", "at", F.explode(F.split(whole, PARTS[kind])).alias("record")).withColumn("record", F.trim("record") if kind in ("nbib", "enl") else F.ltrim("record"))
    cut = cut.filter(F.col("record").rlike(RECORDS[kind]))
    if kind == "bib":
        cut = cut.filter(~F.lower("record").rlike(NO_RECORDS))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the task, which reads less than 2**24 records
    seq = F.when(place < 1 << 24, F.shiftleft("at", 24).bitwiseOR(place)).otherwise(F.raise_error(F.lit("more than 16,777,216 records in one range: lower spark.sql.files.maxPartitionBytes")).cast("long"))
    return cut.select("source", seq.alias("seq"), "record")


def _cut(texts: DataFrame, pattern: str, keep: Column) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("content", "^\\ufeff", ""), "\r\n?", "\n")
    cut = texts.select("source", F.posexplode(F.split(clean, pattern)).alias("seq", "record"))
    return cut.filter(keep).select("source", F.col("seq").cast("long").alias("seq"), "record")


def _parsed(records: DataFrame, parse: Callable[[str], tuple[str | None, str | None, dict[str, str]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, seq, texts = batch.columns
            got = [parse(r) for r in texts.to_pylist()]
            kinds, ids, fields = zip(*got) if got else ((), (), ())
            types = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([source, seq, *(pa.array(x, t) for x, t in zip((kinds, ids, [list(f.items()) for f in fields]), types))], names=["source", "seq", "ENTRYTYPE", "local_id", "fields"])

    return records.select("source", "seq", "record").mapInArrow(run, RECORD)


def _fold(pairs: list[tuple[str, str]], names: dict[str, str]) -> dict[str, str]:
    """Repeated tags of one field are joined; the first tag that fills a single-valued field wins."""
    out: dict[str, str] = {}
    for tag, value in pairs:
        key = names.get(tag, f"tag.{tag}")
        value = value.strip()
        if not value:
            continue
        if key in out:
            if key in JOIN:
                out[key] += JOIN[key] + value
        else:
            out[key] = value
    return out


def parse_bib(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    """One BibTeX entry. Values are in braces, which may nest, in quotes, or bare; lines of a value are joined by a space."""
    head = re.match(r"@\s*([A-Za-z]+)\s*\{\s*([^,\s]*)\s*,?", text)
    if not head:
        return None, None, {}
    fields, at, n = {}, head.end(), len(text)
    name = re.compile(r"\s*,?\s*([A-Za-z][\w.:-]*)\s*=\s*")
    while m := name.match(text, at):
        at = m.end()
        if at < n and text[at] == "{":
            depth, start = 0, at + 1
            while at < n:
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
                if not depth:
                    break
            value = text[start : at - 1]
        elif at < n and text[at] == '"':
            end = text.find('"', at + 1)
            end = n if end < 0 else end
            value, at = text[at + 1 : end], end + 1
        else:
            bare = re.compile(r"[^,}\n]*").match(text, at)
            value, at = bare[0], bare.end()
        value = " ".join(value.split())
        if value:
            fields[m[1].lower()] = value
    kind = head[1].lower()
    return ("misc" if kind in ("www", "electronic") else kind), head[2], fields


def parse_ris(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    pairs = [(m[1], m[2]) for m in re.finditer(r"^([A-Z][A-Z0-9]{1,3}) *- ?(.*)$", text, re.M)]
    tags = dict(reversed(pairs))
    fields = _fold([p for p in pairs if p[0] not in ("TY", "ER", "ID")], RIS_FIELDS)
    if start := fields.pop("start_page", None):
        fields["pages"] = f"{start}--{fields['end_page']}" if fields.get("end_page") else start
    fields.pop("end_page", None)
    return RIS_TYPES.get(tags.get("TY", "").strip(), "misc"), tags.get("ID") or tags.get("AN"), fields


def parse_nbib(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    joined = re.sub(r"\n {6}", " ", text)
    pairs = [(m[1], m[2]) for m in re.finditer(r"^([A-Z]{2,4}) *- (.*)$", joined, re.M)]
    tags = dict(reversed(pairs))
    fields = _fold([p for p in pairs if p[0] not in ("PMID", "OWN", "PT")], NBIB_FIELDS)
    if "year" in fields:
        fields["year"] = fields["year"][:4]
    return ("article" if any(t == "PT" and "Journal" in v for t, v in pairs) or "journal" in fields else "misc"), tags.get("PMID") or tags.get("OID"), fields


def parse_enl(text: str) -> tuple[str | None, str | None, dict[str, str]]:
    pairs = [(m[1], m[2]) for m in re.finditer(r"^%([A-Z0-9]) (.*)$", text, re.M)]
    kind = next((v for t, v in pairs if t == "0"), "")
    return {"Journal Article": "article", "Conference Proceedings": "inproceedings", "Book": "book"}.get(kind.strip(), "misc"), None, _fold([p for p in pairs if p[0] != "0"], ENL_FIELDS)


def read_bib(texts: DataFrame) -> DataFrame:
    return _parsed(_cut(texts, r"(?m)^(?=\s*@)", F.col("record").rlike(r"^\s*@") & ~F.lower("record").rlike(r"^\s*@(comment|preamble|string)")).withColumn("record", F.ltrim("record")), parse_bib)


def read_ris(texts: DataFrame) -> DataFrame:
    return _parsed(_cut(texts, r"(?m)^(?=TY  ?- )", F.col("record").startswith("TY")), parse_ris)


def read_nbib(texts: DataFrame) -> DataFrame:
    return _parsed(_cut(texts, r"\n\s*\n", F.col("record").rlike(r"(?m)^TI *- ")), parse_nbib)


def read_enl(texts: DataFrame) -> DataFrame:
    return _parsed(_cut(texts, r"\n\s*\n", F.col("record").rlike("(?m)^%T ")), parse_enl)


def read_references(lines: DataFrame) -> DataFrame:
    """lines (source, seq, value) of reference lists, a citation text each -> records. Headings and empty lines are none."""
    return _parsed(lines.filter(F.trim("value") != "").filter(~F.substring(F.ltrim("value"), 1, 2).contains("#")).select("source", "seq", F.col("value").alias("record")), parse_reference)


def read_csv(spark: SparkSession, path: str, rename: dict[str, str] | None = None, keep_empty: bool = False) -> DataFrame:
    """A table with headers; all values are strings, empty ones are null (with ``keep_empty`` those without quotes only), columns in lower case."""
    # Spark takes what equals its null value for null, so that is a text no table has; without an escape of the escape it drops NUL beside quotes
    options = {"escape": '"', "charToEscapeQuoteEscaping": '"'} | ({"nullValue": f"null-{uuid.uuid4().hex}"} if keep_empty else {})
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, **options)
    names = {c: (rename or {}).get(c, c.strip().lower().replace(" ", "_")) for c in df.columns}
    value = lambda c: F.col(f"`{c}`") if keep_empty else F.nullif(F.col(f"`{c}`"), F.lit(""))
    return df.select(*(value(c).alias(n) for c, n in names.items()))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, primitivesAsString=True, encoding="UTF-8")


def count_records(texts: DataFrame, kind: str) -> DataFrame:
    """source, n: records of each file, counted by their first lines, without parsing."""
    first = {"bib": r"^\s*@(?!comment)", "ris": "^TY ", "nbib": "^TI ", "enl": "^%T ", "md": r"^\s*[^#\s]", "csv": "^."}[kind]
    lines = texts.select("source", F.explode(F.split("content", "\r?\n")).alias("line"))
    n = lines.filter(F.col("line").rlike(first)).groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("n", F.col("n") - 1) if kind == "csv" else n


PARSERS = {"bib": parse_bib, "ris": parse_ris, "nbib": parse_nbib, "enl": parse_enl}
READERS = {"bib": read_bib, "ris": read_ris, "nbib": read_nbib, "enl": read_enl, "txt": read_enl}


def load(spark: SparkSession, path: str, rename: dict[str, str] | None = None, id_column: str | None = None) -> DataFrame:
    """Records of the file, or the folder of files, at a path, by its suffix: source, seq, ENTRYTYPE, local_id, fields.

    Of tables (csv, json) each column is a field, ``rename`` gives columns other names, and ``id_column`` holds the local id (else it is empty).
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in READERS:
        kind = "enl" if suffix == "txt" else suffix
        return _parsed(split_records(spark, path, kind), PARSERS[kind])
    if suffix == "md":
        return read_references(spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.shiftleft(F.col("_metadata.file_block_start"), 24).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"), "value"))
    if suffix == "xlsx":
        books = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")
        return workbook_records(read_workbooks(books), rename, id_column)
    if suffix not in ("csv", "json"):
        raise NotImplementedError(f"no reader for .{suffix}")
    table = read_csv(spark, path, rename) if suffix == "csv" else read_json(spark, path)
    if suffix == "json":
        table = table.select(*(F.col(f"`{n}`").cast("string").alias((rename or {}).get(n, n.lower())) for n in table.columns))
    return table_records(table, id_column).withColumn("source", F.lit(path))


def table_records(table: DataFrame, id_column: str | None = None) -> DataFrame:
    """Rows of a table as records: ENTRYTYPE from entrytype (misc where it is empty), the other known columns as fields."""
    names = [n for n in table.columns if n.lower() not in ("entrytype", (id_column or "").lower())]
    pairs = F.filter(F.array(*(F.struct(F.lit(n.lower()).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in names)), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    kind = next((F.coalesce(F.lower(F.col(f"`{n}`")), F.lit("misc")) for n in table.columns if n.lower() == "entrytype"), F.lit("misc"))
    local = F.col(f"`{id_column}`").cast("string") if id_column else F.lit(None).cast("string")
    return table.select(F.lit("table").alias("source"), F.monotonically_increasing_id().alias("seq"), kind.alias("ENTRYTYPE"), local.alias("local_id"), F.map_from_entries(pairs).alias("fields"))


def workbook_records(rows: DataFrame, rename: dict[str, str] | None = None, id_column: str | None = None) -> DataFrame:
    """Rows of workbooks (source, seq, cells) as records, as table_records makes them of tables."""
    names = F.create_map(*(F.lit(x) for kv in (rename or {"": ""}).items() for x in kv))
    cells = F.transform_keys("cells", lambda k, v: F.coalesce(F.try_element_at(names, k), F.regexp_replace(F.lower(F.trim(k)), " ", "_")))
    local = F.try_element_at("cells", F.lit(id_column)) if id_column else F.lit(None).cast("string")
    skip = ["entrytype", *([id_column.lower(), id_column] if id_column else [])]
    named = rows.select("source", "seq", cells.alias("fields"), local.alias("local_id"))
    return named.select("source", "seq", F.coalesce(F.lower(F.try_element_at("fields", F.lit("entrytype"))), F.lit("misc")).alias("ENTRYTYPE"), "local_id", F.map_filter("fields", lambda k, v: ~k.isin(*skip)).alias("fields"))


def load_text(spark: SparkSession, text: str, kind: str) -> DataFrame:
    return READERS[kind](spark.createDataFrame([("text", text)], "source string, content string"))


def save(records: DataFrame, path: str) -> None:
    """Records written to a path by its suffix: bib, ris, md (texts in the order of the id), csv (with headers) or xlsx (a folder of workbooks)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    fields = [f for f in ("ID", "ENTRYTYPE", *ORDER) if f in records.columns]
    if suffix == "csv":
        records.select(*fields, *sorted(set(records.columns).difference(fields))).write.csv(path, header=True, escape='"')
        return
    if suffix == "xlsx":
        save_workbooks(workbooks(records, [*fields, *sorted(set(records.columns).difference(fields))]), path)
        return
    texts = {"bib": lambda: bib_text([f for f in ORDER if f in records.columns]), "ris": ris_text, "md": lambda: markdown_row(fields)}
    if suffix not in texts:
        raise NotImplementedError(f"no writer for .{suffix}")
    write_text(records, texts[suffix](), path)


def standard_columns(records: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as columns; others with a namespace (a dot) stay in ``extra``."""
    extra = F.map_filter("fields", lambda k, v: k.contains("."))
    return records.select("source", "seq", "ENTRYTYPE", "local_id", *(F.try_element_at("fields", F.lit(f)).alias(f) for f in fields), extra.alias("extra"))


# ---- writers

ORDER = ["author", "booktitle", "journal", "title", "year", "volume", "number", "pages", "doi", "url", "isbn", "language", "abstract"]


def bib_text(fields: list[str] | None = None) -> Column:
    """One BibTeX entry, fields in order, absent and empty ones left out."""
    lines = [F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.concat(F.lit("   " + f.ljust(28) + " = {"), F.col(f), F.lit("}"))) for f in fields or ORDER]
    return F.concat(F.lit("@"), F.col("ENTRYTYPE"), F.lit("{"), F.col("ID"), F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit(",\n}\n"))


def ris_text() -> Column:
    """One RIS entry: an AU line for each author, pages split into SP and EP."""
    kinds = {v: k for k, v in RIS_TYPES.items() if k in ("JOUR", "CONF", "BOOK", "CHAP", "RPRT", "THES")}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    known = lambda f: F.col(f).isNotNull() & ~F.col(f).isin("", "UNKNOWN")
    line = lambda tag, v, ok: F.when(ok, F.array(F.concat(F.lit(f"{tag}  - "), v))).otherwise(F.array().cast("array<string>"))
    parts = [
        F.array(F.concat(F.lit("TY  - "), F.coalesce(kind[F.col("ENTRYTYPE")], F.lit("GEN")))),
        F.when(known("author"), F.transform(F.split("author", " and "), lambda a: F.concat(F.lit("AU  - "), a))).otherwise(F.array().cast("array<string>")),
        line("TI", F.col("title"), known("title")), line("PY", F.col("year"), known("year")), line("JO", F.col("journal"), known("journal")), line("T2", F.col("booktitle"), known("booktitle")),
        line("VL", F.col("volume"), known("volume")), line("IS", F.col("number"), known("number")),
        line("SP", F.split_part("pages", F.lit("--"), F.lit(1)), known("pages")), line("EP", F.split_part("pages", F.lit("--"), F.lit(2)), known("pages") & F.col("pages").contains("--")),
        line("DO", F.col("doi"), known("doi")), line("UR", F.col("url"), known("url")), F.array(F.lit("ER  - ")),
    ]
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def markdown_row(fields: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(f), F.lit("|"), F.lit("\\|")), F.lit("")) for f in fields)), F.lit(" |"))


def write_text(records: DataFrame, text: Column, path: str, order: str = "ID") -> None:
    """Record texts as files in the order of the id, a range of ids to each file."""
    records.select(order, text.alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)


def merge_by_id(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored records with those of ``changed`` in place of or beside them."""
    return stored.join(changed.select("ID"), "ID", "left_anti").unionByName(changed, allowMissingColumns=True)

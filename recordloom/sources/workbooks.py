"""Workbooks (.xlsx): a task reads the zip and XML parts of one, row by row, and writes one for each part of a table. No spreadsheet library is used."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "source string, seq long, cells map<string,string>"
BOOKS = "source string, content binary"
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
#: what XML can't hold, and what would read as an escape
NOT_PLAIN = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def _column(ref: str) -> int:
    """B7 -> 1."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node: ElementTree.Element | None) -> str:
    """The text of a string item, without phonetic readings."""
    if node is None:
        return ""
    parts = [t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else [])]
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _sheet_part(book: zipfile.ZipFile, sheet: int) -> str:
    """The part of the n-th sheet in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    target = links[sheets[sheet].get(LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(content: bytes, sheet: int = 0) -> Iterator[dict[int, str]]:
    """The rows of a sheet that have cells, as column number -> text. Numbers that are whole have no point, truth values are true and false."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_sheet_part(book, sheet)) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for i, cell in enumerate(node.findall(f"{MAIN}c")):
                    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
                    text = _text(cell.find(f"{MAIN}is")) if kind == "inlineStr" else value or ""
                    if kind == "s" and value:
                        text = shared[int(value)]
                    elif kind == "b":
                        text = {"1": "true", "0": "false"}.get(text, text)
                    elif kind == "n" and re.fullmatch(r"-?\d+\.0+", text):
                        text = text.split(".")[0]
                    if text:
                        cells[_column(cell.get("r")) if cell.get("r") else i] = text
                node.clear()
                if cells:
                    yield cells


def _read(sheet: int, batch_rows: int = 5000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = sheet_rows(content, sheet)
                names = next(rows, {})
                held: list[list[tuple[str, str]]] = []
                seq = 0
                for cells in rows:
                    held.append([(names[i], v) for i, v in sorted(cells.items()) if i in names])
                    if len(held) == batch_rows:
                        yield _batch(source, seq, held)
                        seq, held = seq + len(held), []
                if held:
                    yield _batch(source, seq, held)

    return run


def _batch(source: str, first: int, rows: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    columns = [pa.array([source] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.map_(pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["source", "seq", "cells"])


def read_workbooks(books: DataFrame, sheet: int = 0) -> DataFrame:
    """books (source, content) -> source, seq (from 0), cells (header -> text, empty cells left out): the rows below the first one of a sheet. A workbook is read by one task, row by row; one without rows gives none."""
    return books.select("source", "content").mapInArrow(_read(sheet), ROWS)


def make_workbook(names: list[str], rows: Iterator[list[str | None]]) -> bytes:
    """A workbook with one sheet of texts."""
    out = io.BytesIO()
    plain = lambda v: escape(NOT_PLAIN.sub(lambda m: f"_x{ord(m[0]):04X}_", v))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, types, rels = MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
    office, kinds = LINK[1:].split("}")[0], "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                      f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')  # fmt: skip
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="records" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for r, row in enumerate([list(names)], 1):
                f.write(_row(r, row, plain))
            for r, row in enumerate(rows, 2):
                f.write(_row(r, row, plain))
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _row(number: int, values: list[str | None], plain) -> bytes:
    cells = "".join(f'<c r="{_letters(i)}{number}" t="inlineStr"><is><t xml:space="preserve">{plain(v)}</t></is></c>' for i, v in enumerate(values) if v)
    return f'<row r="{number}">{cells}</row>'.encode()


def workbooks(records: DataFrame, fields: list[str], order: str = "ID", book_rows: int = 100_000) -> DataFrame:
    """Records as workbooks in the order of the id: source (a name), content; a range of ids to each task, and at most ``book_rows`` rows to a workbook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def book() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:04d}.xlsx"]), pa.array([make_workbook(fields, iter(held))], pa.binary())], names=["source", "content"])

        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                held.append(list(row))
                if len(held) == book_rows:
                    yield book()
                    number, held = number + 1, []
        if held:
            yield book()

    texts: list[Column] = [F.col(f).cast("string").alias(f) for f in fields]
    return records.repartitionByRange(order).sortWithinPartitions(order).select(*texts).mapInArrow(run, BOOKS)


def save_workbooks(books: DataFrame, path: str) -> None:
    """Write workbooks into a folder that all executors reach (a URI that pyarrow knows, or a path): each under its name, moved there when it is complete."""

    def run(rows) -> None:
        fs, folder = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(folder, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{folder}/_{r.source}") as f:
                f.write(bytes(r.content))
            fs.move(f"{folder}/_{r.source}", f"{folder}/{r.source}")

    books.foreachPartition(run)

"""Workbooks: round trips, and the forms of cells that other programs write."""

import io
import zipfile

from recordloom.sources import formats
from recordloom.sources.workbooks import make_workbook, read_workbooks, save_workbooks, sheet_rows, workbooks

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>flag</t></is></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>2013</v></c><c r="C3"><v>5</v></c><c r="D3" t="b"><v>1</v></c></row>
<row r="4"/><row r="5"><c r="B5"><v>2014.0</v></c><c r="D5" t="str"><f>A1</f><v>x &amp; y</v></c></row></sheetData></worksheet>"""


def foreign():
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(make_workbook(["a"], iter([])))) as old, zipfile.ZipFile(out, "w") as book:
        for name in old.namelist():
            book.writestr(name, SHEET if name.endswith("sheet1.xml") else old.read(name))
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Title</t></si><si><r><t>Ye</t></r><r><t>ar</t></r><rPh><t>no</t></rPh></si><si><t xml:space="preserve"> A_x000D_ b </t></si></sst>')
    return out.getvalue()


def test_cells_of_other_programs(spark):
    assert list(sheet_rows(foreign())) == [{0: "Title", 1: "Year", 3: "flag"}, {0: " A\r b ", 1: "2013", 2: "5", 3: "true"}, {1: "2014", 3: "x & y"}]
    books = spark.createDataFrame([("f.xlsx", bytearray(foreign())), ("e.xlsx", bytearray(make_workbook(["a"], iter([]))))], "source string, content binary")
    got = read_workbooks(books).orderBy("seq").collect()
    assert [(r.source, r.seq, r.cells) for r in got] == [("f.xlsx", 0, {"Title": " A\r b ", "Year": "2013", "flag": "true"}), ("f.xlsx", 1, {"Year": "2014", "flag": "x & y"})]


def test_round_trip(spark, tmp_path):
    odd = ["plain", "a\nb\tc", "x\x0by\x00z", "_x0041_ stays", "<b> & \"c\" 'd'", "𝒳 é 你", " spaces ", None, "", "=1+1", "0012"]
    rows = [(f"K{i:04d}", odd[i % len(odd)], str(i) if i % 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "ID string, title string, year string")
    books = workbooks(df, ["ID", "title", "year"], book_rows=150)
    got = {r.cells["ID"]: (r.cells.get("title"), r.cells.get("year")) for r in read_workbooks(books).collect()}
    assert got == {k: (t or None, y) for k, t, y in rows} and books.count() >= 7
    save_workbooks(books, f"file://{tmp_path}/books")
    back = formats.load(spark, f"{tmp_path}/books/*.xlsx", {"ID": "ID"}, "ID")
    assert sorted((r.local_id, r.fields.get("title")) for r in back.collect()) == sorted((k, t or None) for k, t, _ in rows)
    formats.save(df, f"{tmp_path}/out.xlsx")
    assert formats.load(spark, f"{tmp_path}/out.xlsx/*.xlsx").count() == 1000

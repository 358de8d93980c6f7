"""Spreadsheets written by hand as zipped XML."""

import io
import zipfile

import pytest

from fieldstone.sources import readers, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(rows, strings=None, sheet="sheet1"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}/>")
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(strings)}</sst>")
        z.writestr(f"xl/worksheets/{sheet}.xml", f"<worksheet {MAIN}><sheetData>{''.join(rows)}</sheetData></worksheet>")
    return out.getvalue()


TYPED = book(
    [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t> Open </t></is></c></row>', '<row r="2"/>', '<row r="3"><c r="A3"><v>7.0</v></c><c r="B3" t="s"><v>2</v></c><c r="C3"><v>9</v></c><c r="D3" t="b"><v>1</v></c></row>',
        '<row r="4"><c r="A4"><v>0.25</v></c><c r="D4" t="e"><v>#N/A</v></c></row>', '<row><c t="str"><f>A1</f><v>calc</v></c><c t="inlineStr"><is><r><t>rich </t></r><r><t>text</t></r></is></c></row>',
    ],
    ["<si><t>Ref</t></si>", "<si><t>PRICE </t></si>", "<si><r><t>£5 &amp; </t></r><r><t>more</t></r><rPh><t>spoken</t></rPh></si>"],
)


def test_types_and_blanks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(TYPED)
    (tmp_path / "b.xlsx").write_bytes(book(['<row><c t="inlineStr"><is><t>ref</t></is></c></row>', *(f"<row><c><v>{i}</v></c></row>" for i in range(1200))], sheet="sheet7"))
    (tmp_path / "c.xlsx").write_bytes(book([]))
    rows = readers.feed(spark, str(tmp_path), "xlsx")
    first = [(r.position, r.row) for r in rows.where("path like '%a.xlsx'").orderBy("position").collect()]
    assert first == [(0, {"ref": "7", "price": "£5 & more", "open": "true"}), (1, {"ref": "0.25", "price": None, "open": None}), (2, {"ref": "calc", "price": "rich text", "open": None})]
    second = rows.where("path like '%b.xlsx'").orderBy("position").collect()
    assert [int(r.row["ref"]) for r in second] == list(range(1200)) == [r.position for r in second] and rows.where("path like '%c.xlsx'").count() == 0
    with pytest.raises(ValueError):
        readers.feed(spark, str(tmp_path), "ods")


def test_places():
    assert [sheets.place(x, 4) for x in ("A1", "Z9", "AA1", "AB12", None)] == [0, 25, 26, 27, 5]

"""Rows of spreadsheets (xlsx): each file a task's row, its sheet read cell by cell from the zipped XML, handed on in batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in a batch.
ROWS = 512
SCHEMA = "path string, position long, row map<string,string>"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def elements(file, name: str) -> Iterator[ElementTree.Element]:
    """The finished elements of a name; each is cleared once it has been looked at, so that a document is never held whole."""
    parents = []
    for event, element in ElementTree.iterparse(file, events=("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if local(element.tag) == name:
            yield element
            element.clear()
            if parents:
                parents[-1].remove(element)


def plain_text(element: ElementTree.Element) -> str:
    """All runs of text; phonetic ones left out."""
    spoken = {id(t) for x in element.iter() if local(x.tag) == "rPh" for t in x.iter()}
    return "".join(t.text or "" for t in element.iter() if local(t.tag) == "t" and id(t) not in spoken)


def place(reference: str | None, before: int) -> int:
    """A cell's column from 0, from its reference (like AB12), else the one after the cell before."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return before + 1
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def value_of(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return plain_text(cell)
    raw = next((v.text for v in cell if local(v.tag) == "v"), None)
    if raw is None or kind == "e":
        return None
    match kind:
        case "s":
            return strings[int(raw)]
        case "b":
            return "true" if raw == "1" else "false"
        case "n":
            number = float(raw)
            return str(int(number)) if number.is_integer() and abs(number) < 1e15 else raw
    return raw


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as texts: whole numbers without a point, TRUE and FALSE in lower case, blanks and errors as None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as f:
                strings = [plain_text(x) for x in elements(f, "si")]
        sheet = "xl/worksheets/sheet1.xml"
        if sheet not in names:
            sheet = min((x for x in names if x.startswith("xl/worksheets/") and x.endswith(".xml")), default="")
        if not sheet:
            return
        with book.open(sheet) as f:
            for row in elements(f, "row"):
                cells: dict[int, str | None] = {}
                at = -1
                for cell in row:
                    if local(cell.tag) == "c":
                        at = place(cell.get("r"), at)
                        cells[at] = value_of(cell, strings)
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """path, position (from 0) and row (header in lower case to text) of xlsx files: the first row is the header; empty rows, and cells without a header, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                header: list[str] | None = None
                held: list[tuple] = []
                position = 0
                for cells in rows_of(content):
                    if not any(x is not None and x.strip() for x in cells):
                        continue
                    if header is None:
                        header = [(x or "").strip().lower() for x in cells]
                        continue
                    held.append((file, position, [(k, v) for k, v in zip(header, cells + [None] * len(header), strict=False) if k]))
                    position += 1
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["path", "position", "row"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["path", "position", "row"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)

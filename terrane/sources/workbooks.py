"""XLSX workbooks as a Spark data source of rows: (file, sheet, n, fields), all as text.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").load(path)       # one .xlsx, or a folder of them

A task reads one sheet of one file, row by row: sheets are streamed, never held as a
tree; only the file's table of shared strings is.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from terrane.sources.vectors import bytes_of, opened

# The XML names of workbooks.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "file string, sheet string, n long, fields array<string>"


def workbooks(path: str) -> list[str]:
    system, inner = opened(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.path.lower().endswith(".xlsx"))
    return [path.rstrip("/") + p[len(inner.rstrip("/")) :] for p in found]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return [(s.get("name"), "xl/" + targets[s.get(LINK)].removeprefix("/xl/")) for s in found]


def texts(book: zipfile.ZipFile) -> list[str]:
    """The shared strings."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append(shown(e))
                e.clear()
    return out


def shown(e: ElementTree.Element) -> str:
    """All text of a string item but its reading aids."""
    return "".join(t.text or "" for child in e if child.tag != f"{MAIN}rPh" for t in child.iter(f"{MAIN}t"))


def column(reference: str) -> int:
    """Where `AB12` stands in its row, from 0."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = 26 * at + ord(c.upper()) - 64
    return at - 1


def plain(kind: str | None, value: str | None) -> str:
    """A cell's value as a CSV of the same table has it: whole numbers without a point, booleans as TRUE and FALSE."""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind in (None, "n") and value and not re.fullmatch(r"-?\d+", value):
        x = float(value)
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)
    return value or ""


def rows(book: zipfile.ZipFile, member: str, known: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number from 0, fields) of the rows that are there; empty cells are empty text."""
    last = -1
    with book.open(member) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            fields: list[str] = []
            for c in e:
                at = column(c.get("r")) if c.get("r") else len(fields)
                kind, value = c.get("t"), c.find(f"{MAIN}v")
                value = None if value is None else value.text
                text = shown(c.find(f"{MAIN}is")) if kind == "inlineStr" and c.find(f"{MAIN}is") is not None else known[int(value)] if kind == "s" and value else plain(kind, value)
                fields += [""] * (at - len(fields)) + [text]
            last = int(e.get("r")) - 1 if e.get("r") else last + 1
            yield last, fields
            e.clear()


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    member: str


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.sheet = workbooks(options["path"]), options.get("sheet")

    def partitions(self) -> list[Sheet]:
        out = []
        for p in self.paths:
            system, inner = opened(p)
            with system.open_input_file(inner) as f, zipfile.ZipFile(f) as book:
                out += [Sheet(p, n, m) for n, m in sheets(book) if self.sheet in (None, n)]
        return out or [Sheet("", "", "")]

    def read(self, part: Sheet) -> Iterator[tuple]:
        if part.member:
            with zipfile.ZipFile(io.BytesIO(bytes_of(part.path))) as book:
                for n, fields in rows(book, part.member, texts(book)):
                    yield part.path, part.name, n, fields


class WorkbookWriter(DataSourceWriter):
    """A workbook of one sheet for each task, from rows of `fields`: whole numbers as numbers, all else as shared strings."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        number: dict[str, int] = {}
        lines = []
        for k, row in enumerate(rows, 1):
            cells = []
            for v in row["fields"] or ():
                v = v or ""
                numeric = v.isascii() and v.isdigit() and (v == "0" or v[0] != "0") and len(v) < 15
                cells.append(f"<c><v>{v}</v></c>" if numeric else f'<c t="s"><v>{number.setdefault(v, len(number))}</v></c>')
            lines.append(f'<row r="{k}">{"".join(cells)}</row>')
        if not lines:
            return WriterCommitMessage()
        space, package = MAIN.strip("{}"), "http://schemas.openxmlformats.org/package/2006"
        office, kind = LINK.split("}")[0].strip("{"), "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets><sheet name="Table" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
            "xl/sharedStrings.xml": f'<sst xmlns="{space}">{"".join(f"<si><t xml:space={chr(34)}preserve{chr(34)}>{escape(v)}</t></si>" for v in number)}</sst>',
        }
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner.rstrip('/')}/part-{uuid.uuid4().hex[:12]}.xlsx") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in parts.items():
                book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        return WriterCommitMessage()


class Workbook(DataSource):
    """Options: sheet, the name of the sheets to read (all without it)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def write_workbooks(df: DataFrame, path: str) -> None:
    """A workbook for each partition, from rows of `fields` in their order."""
    df.sparkSession.dataSource.register(Workbook)
    df.select(F.col("fields")).write.format("workbook").mode("append").save(path)

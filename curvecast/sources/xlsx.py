"""Workbooks (.xlsx) as a Spark data source: `spark.read.format("xlsx")` and `df.write.format("xlsx")`.

A file is one partition; a workbook is a zip of XML parts, read row by row with the standard library.
Paths are those of pyarrow.fs: a local or shared folder, file:// or hdfs://, that every executor sees.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, StringType, StructType

# The names and namespaces of the format's parts.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_TYPES = f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_ROOT = f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
_BOOK_RELS = f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def _column(ref: str) -> int:
    """The place, from 0, of a cell by the letters of its name (A1: 0, AA1: 26)."""
    n = 0
    for letter in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node) -> str:
    """The text of a string item, its runs joined; phonetic readings are no part of it."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{{{_MAIN}}}t" else child.findall(f"{{{_MAIN}}}t") if child.tag == f"{{{_MAIN}}}r" else []))


def rows(data: bytes, sheet: str | None = None) -> Iterator[dict[int, str]]:
    """The cells of each row of a sheet (by name; else the first) by column; empty ones are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(book.read("xl/workbook.xml")).find(f"{{{_MAIN}}}sheets")
        found = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet {sheet}")
        target = targets[found.get(f"{{{_REL}}}id")]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(item) for item in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, node in ET.iterparse(part):
                if node.tag == f"{{{_MAIN}}}row":
                    cells = {}
                    for place, c in enumerate(node.findall(f"{{{_MAIN}}}c")):
                        kind, v, inline = c.get("t"), c.find(f"{{{_MAIN}}}v"), c.find(f"{{{_MAIN}}}is")
                        value = _text(inline) if inline is not None else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                        if value is not None and kind != "e":
                            cells[_column(c.get("r")) if c.get("r") else place] = value
                    yield cells
                    node.clear()


def _typed(value: str | None, kind):
    """A cell in a column's type; null where it is no number (or no flag) though it should be one."""
    if value is None or isinstance(kind, StringType):
        return value
    if isinstance(kind, BooleanType):
        return {"1": True, "0": False, "true": True, "false": False}.get(value.strip().lower())
    try:
        return float(value) if kind.typeName() in ("double", "float") else int(value) if re.fullmatch("-?[0-9]+", value) else int(float(value))
    except (ValueError, OverflowError):
        return None


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Xlsx(DataSource):
    """Options: path (a file or a folder of .xlsx files), sheet (a name; else the first). The first row holds
    the names; a schema must be given, and its columns are found by name. A name that a file lacks is null."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        self.path, self.sheet, self.schema = path, sheet, schema

    def partitions(self) -> list[InputPartition]:
        store, path = _open(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".xlsx")]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = _open(self.path)
        with store.open_input_stream(partition.path) as stream:
            lines = rows(stream.read(), self.sheet)
        places = {name: at for at, name in sorted(next(lines, {}).items(), reverse=True)}  # of names that repeat, the first
        wanted = [(places.get(field.name), field.dataType) for field in self.schema]
        for cells in lines:
            if cells:
                yield tuple(_typed(cells.get(at), kind) for at, kind in wanted)


class _Writer(DataSourceWriter):
    """One workbook a task. A failed job's files are removed; those of lost attempts stay out of the way
    under a name that readers skip."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator) -> WriterCommitMessage:
        store, folder = _open(self.path)
        lines = [self._line(f.name for f in self.schema)] + [self._line(r) for r in iterator]
        if len(lines) == 1:
            return _Written(None)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}.part"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _BOOK_RELS)):
                book.writestr(part, text)
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        with store.open_output_stream(path) as stream:
            stream.write(buffer.getvalue())
        return _Written(path)

    @staticmethod
    def _line(values) -> str:
        def cell(v) -> str:
            if v is None:
                return "<c/>"
            if isinstance(v, bool):
                return f'<c t="b"><v>{int(v)}</v></c>'
            if isinstance(v, (int, float)):
                return f"<c><v>{v!r}</v></c>"
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

        return f"<row>{''.join(cell(v) for v in values)}</row>"

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                store.move(m.path, m.path.removesuffix(".part") + ".xlsx")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xlsx)

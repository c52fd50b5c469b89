"""Spreadsheets: a data source that streams sheets in tasks, all cells as strings, and a plain writer.

``spark.read.format("xlsx")`` reads a file, a folder or a pattern once ``register`` has named it. A partition is
one sheet of one file, which the format itself bounds by 1,048,576 rows; a task holds the sheet's texts that cells
share, packed, and a block of rows. Files are opened by pyarrow's file systems (local, HDFS, S3, GCS), parts of
them by range, so no file is held whole anywhere.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of one Arrow batch.
BLOCK = 4_096
#: Fixed value: rows that one sheet may have.
MOST_ROWS = 1_048_576


def _at(path: str):
    """File system and path of a place; one without a scheme, or under ``file:``, is local."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe=":/?=&@"))
    local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.LocalFileSystem(), posixpath.abspath(local)


def files_of(path: str) -> list[str]:
    """The files at ``path``: itself, those of a folder and the folders in it, or those that a pattern in its last part names. Hidden ones are left out."""
    from pyarrow import fs

    path = path.rstrip("/")
    system, where = _at(path)
    folder, last = posixpath.split(where)
    if any(c in last for c in "*?["):
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, last)]
    elif system.get_file_info(where).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.path.endswith(".xlsx")]
    else:
        found = [where]
    shown = sorted(f for f in found if not posixpath.basename(f).startswith((".", "_", "~")))
    if not shown:
        raise FileNotFoundError(f"no workbook at {path}")
    prefix = path.removesuffix(where) if "://" in path and not path.startswith("file:") else ""
    return [prefix + f for f in shown]


def sheet_names(source) -> dict[str, str]:
    """Sheet name to the part that holds it, in the workbook's order, of a workbook's bytes or open zip."""
    if isinstance(source, bytes):
        with zipfile.ZipFile(io.BytesIO(source)) as z:
            return sheet_names(z)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(source.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(source.read("xl/workbook.xml")).iter(f"{NS}sheet")
    return {s.get("name"): "xl/" + targets[s.get(REL)].lstrip("/").removeprefix("xl/") for s in sheets}


def _elements(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements with a tag, one at a time; each is let go when the next is asked for."""
    with z.open(part) as f:
        above = []
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == f"{NS}{tag}":
                yield e
                e.clear()
                if above:
                    above[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """A text and its runs, without readings in another script."""
    return "".join(t.text or "" for t in [*e.findall(f"{NS}t"), *e.findall(f"{NS}r/{NS}t")])


def _shared(z: zipfile.ZipFile):
    """The texts that cells share, as one packed array."""
    import pyarrow as pa

    if "xl/sharedStrings.xml" not in z.namelist():
        return pa.chunked_array([], pa.large_string())
    chunks, block = [], []
    for s in _elements(z, "xl/sharedStrings.xml", "si"):
        block.append(_text(s))
        if len(block) == BLOCK:
            chunks.append(pa.array(block, pa.large_string()))
            block = []
    return pa.chunked_array([*chunks, pa.array(block, pa.large_string())]).combine_chunks()


def _rows(z: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet, cells by column; a cell without an address follows the one before."""
    shared = None
    for row in _elements(z, part, "row"):
        cells: dict[int, str | None] = {}
        at = 0
        for c in row.findall(f"{NS}c"):
            if address := re.match(r"[A-Z]+", c.get("r", "")):
                at = 0
                for letter in address[0]:
                    at = at * 26 + ord(letter) - 64
            else:
                at += 1
            v, inline = c.find(f"{NS}v"), c.find(f"{NS}is")
            text = _text(inline) if inline is not None else v.text if v is not None else None
            if c.get("t") == "s" and text is not None:
                shared = _shared(z) if shared is None else shared
                text = shared[int(text)].as_py()
            cells[at - 1] = text
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def rows_of(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """All rows of one sheet of a small workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sheet_names(z)
        return list(_rows(z, names[sheet] if sheet else next(iter(names.values()))))


def _named(head: list[str | None]) -> list[str]:
    """Column names of a header row: empty ones by place, repeated ones with a number."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(head):
        name = h or f"column_{i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


@dataclass
class Sheet(InputPartition):
    """One sheet of one file, by its part in the file."""

    path: str
    part: str


class SheetReader(DataSourceReader):
    """Rows of the sheets asked for, a partition a sheet."""

    def __init__(self, schema: T.StructType, path: str, sheet: str | None):
        self.names, self.path, self.sheet = schema.names, path, sheet

    def partitions(self) -> list[Sheet]:
        return [Sheet(f, part) for f in files_of(self.path) for part in chosen(f, self.sheet)]

    def read(self, partition: Sheet):
        import pyarrow as pa

        width = len(self.names)
        schema = pa.schema([(n, pa.string()) for n in self.names])
        system, where = _at(partition.path)
        with system.open_input_file(where) as f, zipfile.ZipFile(f) as z:
            rows = _rows(z, partition.part)
            head = _named(next(rows, []))
            if head and head != self.names:
                raise ValueError(f"{partition.path} ({partition.part}) has the header {head}, not {self.names}")
            block = []
            for row in rows:
                block.append([*row, *[None] * (width - len(row))][:width])
                if len(block) == BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block)], schema=schema)
                    block = []
            if block and width:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block)], schema=schema)


def chosen(path: str, sheet: str | None) -> list[str]:
    """The parts of a file's first sheet, of the named one, or of all for ``*``."""
    system, where = _at(path)
    with system.open_input_file(where) as f, zipfile.ZipFile(f) as z:
        names = sheet_names(z)
    if sheet == "*":
        return list(names.values())
    if sheet and sheet not in names:
        raise ValueError(f"{path} has no sheet {sheet!r}, but {list(names)}")
    return [names[sheet] if sheet else next(iter(names.values()))]


class XlsxSource(DataSource):
    """``format("xlsx")``: options ``path`` and ``sheet`` (the first by default, ``*`` for all). The first row names the columns, all strings.

    All sheets read together have the same header, or the read fails; sheets without any row hold nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        for f in files_of(self.options["path"]):
            for part in chosen(f, self.options.get("sheet")):
                system, where = _at(f)
                with system.open_input_file(where) as opened, zipfile.ZipFile(opened) as z:
                    head = _named(next(_rows(z, part), []))
                if head:
                    return T.StructType([T.StructField(n, T.StringType()) for n in head])
        return T.StructType([])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(schema, self.options["path"], self.options.get("sheet"))


def register(spark: SparkSession) -> None:
    """Name the ``xlsx`` format in a session."""
    spark.dataSource.register(XlsxSource)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first by default) of every workbook at ``path``, every column a string."""
    register(spark)
    reader = spark.read.format("xlsx")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def xlsx_bytes(df: DataFrame, text: list[str]) -> bytes:
    """A table as a one-sheet workbook; ``text`` columns stay text, so leading zeros survive. More rows than a sheet may have are refused."""
    if df.limit(MOST_ROWS).count() == MOST_ROWS:
        raise ValueError(f"a sheet has at most {MOST_ROWS} rows, its header included")

    def cell(name, v):
        if v is None:
            return "<c/>"
        if name not in text and isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    rows = ["<row>" + "".join(cell(None, c) for c in df.columns) + "</row>"]
    rows += ["<row>" + "".join(cell(n, v) for n, v in zip(df.columns, r)) + "</row>" for r in df.toLocalIterator()]
    body = re.sub(r"<row>.*?</row>", lambda m, n=iter(range(1, len(rows) + 1)): _addressed(m[0], next(n)), "".join(rows), flags=re.S)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text_ in parts.items():
            z.writestr(name, head + text_)
    return out.getvalue()


def _addressed(row: str, n: int) -> str:
    """Give a row's cells their addresses."""
    def letters(i: int) -> str:
        out = ""
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out
    places = iter(range(1, 16_385))
    return re.sub(r"<c(?=[ />])", lambda m: f'<c r="{letters(next(places))}{n}"', row).replace("<row>", f'<row r="{n}">', 1)

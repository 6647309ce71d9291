"""XLSX workbooks as rows of typed cells, read in the tasks with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import MOST_EXPANDED_BYTES, MOST_FILE_BYTES

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats that show a date.
_DATE_FORMATS = {14, 15, 16, 17, 22}
_EPOCH = dt.date(1899, 12, 30)

CELLS = "path string, row_number int, cells array<struct<kind:string,value:string>>, problem string"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _streamed(file, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag as they end; each is dropped after its use, so a sheet is never a whole tree."""
    root = None
    for event, element in ElementTree.iterparse(file, events=("start", "end")):
        if root is None:
            root = element
        if event == "end" and element.tag == tag:
            yield element
            element.clear()
            for parent in root:
                if element in parent:
                    parent.remove(element)


def _sheet_rows(raw: bytes, sheet: str) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
    """(row number, column -> (kind, value)); kinds are text, date, number, boolean, formula."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = next((links[s.get(_REL)] for s in book.iter(f"{_NS}sheet") if s.get("name") == sheet), None)
        if target is None:
            raise ValueError(f"no sheet named {sheet}")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_NS}numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            formats = styles.find(f"{_NS}cellXfs")
            dates = {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in _streamed(z.open(part), f"{_NS}row"):
            cells = {}
            for c in row.iter(f"{_NS}c"):
                value, kind = c.find(f"{_NS}v"), c.get("t", "n")
                text = value.text or "" if value is not None else ""
                if c.find(f"{_NS}f") is not None:
                    found = ("formula", text)
                elif kind == "s":
                    found = ("text", shared[int(text)])
                elif kind == "inlineStr":
                    found = ("text", "".join(t.text or "" for t in c.iter(f"{_NS}t")))
                elif kind == "str":
                    found = ("text", text)
                elif kind == "b":
                    found = ("boolean", text)
                elif text and int(c.get("s", 0)) in dates:
                    found = ("date", (_EPOCH + dt.timedelta(days=int(float(text)))).isoformat())
                elif text:
                    found = ("number", text)
                else:
                    continue
                cells[_column(c.get("r"))] = found
            yield int(row.get("r")), cells


def _expanded(raw: bytes) -> int:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return sum(e.file_size for e in z.infolist())


def _file_rows(path: str, raw: bytes, sheet: str, headers: tuple[str, ...], most_rows: int) -> list[tuple]:
    """The rows of one file as of ``CELLS``; what is wrong with the whole of it is a single row."""
    width, out, checked = len(headers), [], False
    try:
        if _expanded(raw) > MOST_EXPANDED_BYTES:
            return [(path, None, None, "format")]
        for number, cells in _sheet_rows(raw, sheet):
            if not checked:
                checked = True
                names = [cells.get(i, ("text", ""))[1].strip() for i in range(max([width - 1, *cells]) + 1)]
                if number != 1 or names != list(headers):
                    return [(path, None, None, "headers")]
                continue
            if not any(v.strip() for _, v in cells.values()):
                continue
            if len(out) == most_rows:
                return [(path, None, None, "too many rows")]
            out.append((path, number, [{"kind": cells[i][0], "value": cells[i][1]} if i in cells else None for i in range(width)], None))
    except Exception:  # noqa: BLE001  a broken file is a reported row, not a failed job
        return [(path, None, None, "format")]
    problem = "headers" if not checked else "no rows" if not out else None
    return [(path, None, None, problem)] if problem else out


def read_workbooks(files: DataFrame, sheet: str, headers: tuple[str, ...], most_rows: int = 10_000) -> DataFrame:
    """(path, row_number, cells, problem) of (path, content).

    The first row must have exactly the headers, after trimming; wholly blank rows are
    skipped but rows keep their numbers. What is wrong with a whole file is one row with
    a ``problem``: another sheet, header or format, no rows, or more than ``most_rows``. A
    package that expands beyond ``MOST_EXPANDED_BYTES`` isn't opened, and a sheet is read
    as a stream.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                rows = _file_rows(path, raw, sheet, headers, most_rows)
                yield pd.DataFrame(rows, columns=["path", "row_number", "cells", "problem"]).astype({"row_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS)


@dataclass
class WorkbookFile(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    """One partition for each workbook under a path."""

    def __init__(self, options: dict[str, str]):
        if missing := [k for k in ("path", "sheet", "headers") if not options.get(k)]:
            raise ValueError(f"workbooks need the options {missing}")
        self.path, self.sheet = options["path"], options["sheet"]
        self.headers = tuple(json.loads(options["headers"]))
        self.most_rows = int(options.get("mostrows", 10_000))
        self.most_bytes = int(options.get("mostbytes", MOST_FILE_BYTES))

    def partitions(self) -> list[InputPartition]:
        files, root = FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        if found.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.type == FileType.File else files.get_file_info(FileSelector(root, recursive=True))
        return [WorkbookFile(f.path) for f in sorted(listed, key=lambda f: f.path) if f.type == FileType.File and f.path.lower().endswith(".xlsx")]

    def read(self, partition: WorkbookFile) -> Iterator[tuple]:
        files, _ = FileSystem.from_uri(self.path)
        if files.get_file_info(partition.path).size > self.most_bytes:
            yield (partition.path, None, None, "too large")
            return
        with files.open_input_stream(partition.path) as stream:
            raw = stream.read()
        for path, number, cells, problem in _file_rows(partition.path, raw, self.sheet, self.headers, self.most_rows):
            yield path, number, cells and [c and Row(**c) for c in cells], problem


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")`` with the options sheet, headers (a JSON list), mostRows and mostBytes.

    Rows are those of ``read_workbooks``. Files are listed by the driver and read in the
    tasks through Arrow's file systems, so a path is a local one or a URI that these know.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)

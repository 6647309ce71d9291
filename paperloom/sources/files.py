"""Stored files: bounded reads, what a file is by its first bytes or entries, and text of packages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions, and a file's first bytes or the package entry it must have.
SIGNATURES = {
    ".pdf": "255044462D",
    ".png": "89504E470D0A1A0A",
    ".jpg": "FFD8FF",
    ".jpeg": "FFD8FF",
}
PACKAGE_ENTRIES = {".docx": "word/document.xml", ".xlsx": "xl/workbook.xml"}
MOST_FILE_BYTES = 10 * 2**20
MOST_EXPANDED_BYTES = 100 * 2**20


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """(path, length, content) of the files that aren't too large; the length filter reaches the reader, so others aren't opened."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes).select("path", "length", "content")


def open_by_key(files: DataFrame, root: str, key: str) -> DataFrame:
    """The file of a storage key, or none; keys that leave the root are refused. The whole path decides, in the form that Spark's readers give."""
    if key.startswith("/") or ".." in key.replace("\\", "/").split("/"):
        raise ValueError("a key stays under its root")
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{key}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    return files.filter(F.col("path") == whole.toString())


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def _entries(content: pd.Series) -> pd.Series:
    def of(raw):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return [{"name": e.filename, "size": e.file_size} for e in z.infolist()]
        except Exception:  # noqa: BLE001  whatever is wrong with it, it is no package
            return None

    return content.map(of)


def package_entries(content: str | Column) -> Column:
    """Entries (name, size) of ZIP packages; null for anything else."""
    return F.pandas_udf(_entries, "array<struct<name:string,size:long>>")(content)


def file_checks(files: DataFrame, name: str = "path") -> DataFrame:
    """``files`` with ``kind`` (extension) and ``expected``: whether the content is what the extension says. Only packages are opened in Python."""
    ext = extension(F.col(name))
    package = ext.isin(*PACKAGE_ENTRIES)
    names = F.transform(F.when(package, package_entries("content")), lambda e: e["name"])
    good = F.lit(False)
    for x, start in SIGNATURES.items():
        good = good | ((ext == x) & (F.substring("content", 1, len(start) // 2) == F.unhex(F.lit(start))))
    for x, entry in PACKAGE_ENTRIES.items():
        good = good | ((ext == x) & F.coalesce(F.array_contains(names, "[Content_Types].xml") & F.array_contains(names, entry), F.lit(False)))
    return files.withColumns({"kind": ext, "expected": good})


def safe_package(content: Column, most_bytes: int = MOST_EXPANDED_BYTES) -> Column:
    """Whether a workbook package expands within the limit and has its two main entries, in any case of letters."""
    entries = package_entries(content)
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + e["size"])
    names = F.transform(entries, lambda e: F.lower(e["name"]))
    both = F.array_contains(names, "[content_types].xml") & F.array_contains(names, "xl/workbook.xml")
    return F.coalesce((total <= most_bytes) & both, F.lit(False))


def _text_of(raw: bytes, kind: str) -> str | None:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        entry = PACKAGE_ENTRIES[kind] if kind == ".docx" else "xl/sharedStrings.xml"
        root = ElementTree.fromstring(z.read(entry))
    block = "p" if kind == ".docx" else "si"
    parts = []
    for e in root.iter():
        if e.tag.endswith("}" + block):
            parts.append("".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")))
    return "\n".join(parts)


def extract_texts(files: DataFrame) -> DataFrame:
    """(path, extraction_status, extracted_text, extraction_error) of (path, content): an extension; text of DOCX and XLSX packages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                kind = (re.search(r"\.[^./\\]+$", path.lower()) or [""])[0]
                if kind not in PACKAGE_ENTRIES:
                    rows.append((path, "Unsupported", None, None))
                    continue
                try:
                    rows.append((path, "Succeeded", _text_of(raw, kind), None))
                except Exception as e:  # noqa: BLE001  a broken file is a failed row, not a failed job
                    rows.append((path, "Failed", None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "extraction_status", "extracted_text", "extraction_error"])

    return files.select("path", "content").mapInPandas(run, "path string, extraction_status string, extracted_text string, extraction_error string")

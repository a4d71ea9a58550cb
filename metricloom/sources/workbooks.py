"""Spreadsheet files as a job: one workbook per record, cells out as rows.

A workbook is a small compressed file that cannot be split, so the unit of work is the
file: ``binaryFile`` spreads files over tasks and ``mapInArrow`` reads their cells.  A sheet is
parsed row by row, and its cells wait in a temporary file until the whole workbook has been
read, so a task holds the compressed file, its shared strings and one batch of cells.
"""

from __future__ import annotations

import io
import posixpath
import tempfile
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# XML namespaces and the built-in date formats of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

CELLS = "path string, sheet string, state string, row_number int, column int, value string, problem string"
_BATCH = 10_000


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in links.iter(f"{_PACKAGE}Relationship")}
    out = []
    for sheet in root.iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        member = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
        out.append((sheet.get("name"), sheet.get("state", "visible"), member))
    return out


def _elements(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one name in their order; each is dropped when the next one is asked for."""
    above: list[ElementTree.Element] = []
    with book.open(member) as part:
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == tag:
                yield element
                if above:
                    above[-1].clear()


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    items = _elements(book, "xl/sharedStrings.xml", f"{_MAIN}si")
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in items]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for fmt in root.iter(f"{_MAIN}numFmt"):
        own[int(fmt.get("numFmtId"))] = fmt.get("formatCode", "").lower()
    dated = set()
    formats = root.find(f"{_MAIN}cellXfs")
    for i, xf in enumerate(formats if formats is not None else ()):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FORMATS or any(m in own.get(fid, "") for m in ("yy", "dd", "hh")):
            dated.add(i)
    return dated


def _column_index(reference: str) -> int:
    index = 0
    for ch in reference:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - 64
    return index


def _cell(cell, texts: list[str], dated: set[int]) -> tuple[str, str | None]:
    if cell.find(f"{_MAIN}f") is not None:
        return "", "formula"
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")), None
    node = cell.find(f"{_MAIN}v")
    if node is None or node.text is None:
        return "", None
    if kind == "s":
        return texts[int(node.text)], None
    if kind == "b":
        return ("true" if node.text == "1" else "false"), None
    if kind == "e":
        return "", "error"
    if kind in ("str", "d"):
        return node.text, None
    number = float(node.text)
    if int(cell.get("s", "0")) in dated:
        # Serial days count from 1899-12-30.
        return (datetime(1899, 12, 30) + timedelta(days=number)).isoformat(), None
    return (str(int(number)) if number.is_integer() and "." not in node.text else repr(number)), None


def _cells_of_book(book: zipfile.ZipFile, path: str | None) -> Iterator[tuple]:
    texts, dated = _texts(book), _date_styles(book)
    for name, state, member in _sheets(book):
        yield path, name, state, 0, 0, None, None
        for row in _elements(book, member, f"{_MAIN}row"):
            number = int(row.get("r"))
            for cell in row.iter(f"{_MAIN}c"):
                value, problem = _cell(cell, texts, dated)
                yield path, name, state, number, _column_index(cell.get("r")), value, problem


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CELLS.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), schema.types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            # a workbook that turns out to be unreadable gives none of its cells
            with tempfile.TemporaryFile() as kept:
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as book, pa.ipc.new_stream(kept, schema) as to:
                        found = _cells_of_book(book, path)
                        while rows := list(islice(found, _BATCH)):
                            to.write_batch(batch_of(rows))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                    yield batch_of([(path, None, None, 0, 0, None, "unreadable")])
                    continue
                kept.seek(0)
                with pa.ipc.open_stream(kept) as read:
                    yield from read


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of every workbook below a path; row 0 announces each sheet."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xlsx")
        .load(path)
        .select("path", "content")
    )
    return cells_of(files)


def cells_of(files: DataFrame) -> DataFrame:
    """Every cell of the workbooks of a frame with ``path`` and ``content``."""
    return files.select("path", "content").mapInArrow(_read, CELLS)


def sheets(spark: SparkSession, path: str, *, visible_only: bool = True) -> DataFrame:
    """(path, sheet, state) of the sheets below a path."""
    return sheets_of(cells(spark, path), visible_only=visible_only)


def sheets_of(found: DataFrame, *, visible_only: bool = True) -> DataFrame:
    """(path, sheet, state) of the sheets among cells."""
    named = found.where((F.col("row_number") == 0) & F.col("sheet").isNotNull()).select("path", "sheet", "state")
    return named.where(F.col("state") == "visible") if visible_only else named


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Rows of one sheet name over all workbooks below a path, all as text.

    Header names become columns; rows whose cells are all empty are dropped.
    """
    from metricloom.sources.tables import SourceError, check_headers

    found = cells(spark, path).where(
        (F.col("sheet") == sheet) & (F.col("state") == "visible") & (F.col("row_number") > 0)
    )
    bad = found.where(F.col("problem").isNotNull()).select("problem").limit(1).collect()
    if bad:
        raise SourceError(f"The sheet holds a {bad[0]['problem']} cell.")
    header = found.where(F.col("row_number") == 1)
    # Distinct header cells of one layout: as many rows as the sheet has columns.
    names = header.select("column", "value").distinct().orderBy("column").collect()
    if not names:
        raise SourceError("The sheet is unavailable or empty.")
    labels = check_headers([r["value"] or "" for r in names])
    picks = [
        F.coalesce(F.max(F.when(F.col("column") == r["column"], F.col("value"))), F.lit("")).alias(n)
        for r, n in zip(names, labels, strict=True)
    ]
    filled = F.lit(False)
    for n in labels:
        filled = filled | (F.col(f"`{n}`") != "")
    rows = found.where(F.col("row_number") > 1).groupBy("path", "row_number").agg(*picks)
    return rows.where(filled).select("path", "row_number", *[F.col(f"`{n}`") for n in labels])

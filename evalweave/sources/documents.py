"""Sources that need a parser of their own: HTML tables, FASTA, workbooks and word-processor tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Cells(HTMLParser):
    """Text of elements of some tags, in order, with the attribute of interest."""

    def __init__(self, tags: set[str], attribute: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attribute, self.found, self._open = tags, attribute, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.tags:
            self._open.append([tag, dict(attrs).get(self.attribute), []])

    def handle_data(self, data):
        if self._open:
            self._open[-1][2].append(data)

    def handle_endtag(self, tag):
        if tag in self.tags and self._open and self._open[-1][0] == tag:
            name, value, parts = self._open.pop()
            self.found.append((name, value, " ".join("".join(parts).split())))


def html_elements(df: DataFrame, id_col: str, html_col: str, tags: list[str], attribute: str = "href") -> DataFrame:
    """(id, position, tag, attribute, text) of every element of the tags, as they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Cells(set(tags), attribute)
                parser.feed(html or "")
                rows += [(key, i, *found) for i, found in enumerate(parser.found)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["id", "position", "tag", "attribute", "text"])

    return df.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, "id long, position int, tag string, attribute string, text string")


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, contig, header, seq) of plain or gzipped FASTA: records are cut at the line that opens one while
    the file is read as text, so files may be of any size."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    header = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"\s+", "")
    return records.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), F.regexp_extract(header, r"^(\S+)", 1).alias("contig"), header.alias("header"), F.upper(body).alias("seq"))


def _office_rows(name: str, content: bytes) -> list[tuple[str, int, list[str]]]:
    """(table, row, cells) of the tables of a .docx, or of the sheets of an .xlsx."""
    package = zipfile.ZipFile(io.BytesIO(content))
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    rows = []
    if name.endswith(".docx"):
        body = ElementTree.fromstring(package.read("word/document.xml"))
        for t, found in enumerate(e for e in body.iter() if local(e) == "tbl"):
            rows += [(str(t), r, [text(c).strip() for c in row if local(c) == "tc"]) for r, row in enumerate(e for e in found if local(e) == "tr")]
        return rows
    shared = []
    if "xl/sharedStrings.xml" in package.namelist():
        shared = [text(e) for e in ElementTree.fromstring(package.read("xl/sharedStrings.xml")) if local(e) == "si"]
    for sheet in sorted(n for n in package.namelist() if n.startswith("xl/worksheets/sheet")):
        tree = ElementTree.fromstring(package.read(sheet))
        for r, row in enumerate(e for e in tree.iter() if local(e) == "row"):
            cells: list[str] = []
            for c in (e for e in row if local(e) == "c"):
                column = 0
                for ch in "".join(x for x in c.get("r", "A") if x.isalpha()):
                    column = column * 26 + ord(ch) - 64
                cells += [""] * (column - 1 - len(cells))
                value = next((e.text or "" for e in c if local(e) == "v"), text(c))
                cells.append(shared[int(value)] if c.get("t") == "s" else value)
            rows.append((sheet.rpartition("/")[2].removesuffix(".xml"), r, cells))
    return rows


def scan_office_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row, cells) of workbooks and documents; each file is small enough for one task."""
    return office_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def office_rows(files: DataFrame) -> DataFrame:
    """The same of a table (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.rpartition("/")[2], *r) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _office_rows(p, c)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["file", "table", "row", "cells"])

    return files.mapInArrow(run, "file string, table string, row int, cells array<string>")

"""Files of many kinds to pages of text, and the checks on uploads."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserine.functions import text as T

MAX_BYTES, TABLE_ROWS = 100 * 1024 * 1024, 101
# What may be uploaded, and the media type of each suffix.
MEDIA = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "html": "text/html",
    "htm": "text/html",
}


def media_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.coalesce(F.try_element_at(table, T.extension(name)), F.lit("application/octet-stream"))


#: Bytes of a text that are looked at; fixed values: where the members of an office file stand, and what an HTML page has one of.
SAMPLE = 4096
MEMBERS = {"docx": "word/", "xlsx": "xl/", "pptx": "ppt/"}
PAGE = ("<html", "<body", "<!doctype html")


@F.pandas_udf(StringType())
def _members(contents: pd.Series) -> pd.Series:
    """The first folders of an office file's members, one after the other; null for what is no archive."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return " ".join(sorted({n.partition("/")[0] + "/" for n in archive.namelist() if "/" in n}))
        except zipfile.BadZipFile:
            return None

    return contents.map(one)


def upload_error(name: Column, content: Column, media: Column | None = None) -> Column:
    """Why a file is refused, null if it is not: suffix, media type, size, or content that does not fit the suffix.

    A media type counts without its parameters; none stands for any.  A text must be UTF-8
    in its first SAMPLE bytes (of a longer one the last three may be part of a character), and a page of HTML
    look like one.
    """
    kind, head = T.extension(name), F.hex(F.substring(content, 1, 8))
    zipped, ole = kind.isin(*MEMBERS), kind.isin("doc", "ppt", "xls")
    textual, page = kind.isin("csv", "md", "markdown", "txt", "html", "htm"), kind.isin("html", "htm")
    given = F.lower(F.trim(F.element_at(F.split(F.coalesce(media if media is not None else F.lit(None), F.lit("application/octet-stream")), ";"), 1)))
    sample = F.substring(content, 1, SAMPLE)
    whole = F.octet_length(content) <= SAMPLE
    valid = F.is_valid_utf8(sample.cast("string"))
    for less in (1, 2, 3):
        valid = valid | (~whole & F.is_valid_utf8(F.substring(content, 1, SAMPLE - less).cast("string")))
    looks = F.lit(False)
    for mark in PAGE:
        looks = looks | F.contains(F.lower(sample.cast("string")), F.lit(mark))
    folder = F.try_element_at(F.create_map(*[F.lit(x) for kv in MEMBERS.items() for x in kv]), kind)
    inside = F.array_contains(F.split(F.coalesce(_members(F.when(zipped, content)), F.lit("")), " "), folder)
    return (
        F.when(~kind.isin(*MEDIA), "suffix")
        .when(~given.isin(*MEDIA.values(), "application/octet-stream"), "media type")
        .when(F.octet_length(content) > MAX_BYTES, "size")
        .when((kind == "pdf") & ~head.startswith("255044462D"), "not a pdf")
        .when(zipped & ~(head.startswith("504B0304") & inside), "not an office file")
        .when(ole & ~head.startswith("D0CF11E0A1B11AE1"), "not an office file")
        .when(textual & (F.hex(sample).rlike("^(..)*00") | ~valid), "not text")
        .when(page & ~looks, "not html")
    )


def markdown_table(rows: list[list]) -> str:
    if not rows:
        return ""
    cells = [["" if c is None else str(c) for c in r] for r in rows]
    lines = [f"| {' | '.join(r)} |" for r in cells]
    return "\n".join([lines[0], f"| {' | '.join('---' for _ in cells[0])} |", *lines[1:]])


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        self._skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self._skip -= tag in ("script", "style") and self._skip > 0

    def handle_data(self, data):
        if not self._skip and data.strip():
            self.parts.append(data.strip())


def _xml_texts(data: bytes, row: str, cell: str) -> list[str]:
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rpartition("}")[2]
    return ["".join(t.text or "" for t in p.iter() if local(t) == cell) for p in root.iter() if local(p) == row]


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list]]]:
    shared = _xml_texts(book.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in book.namelist() else []
    names = re.findall(r'<(?:\w+:)?sheet\b[^>]*\bname="([^"]*)"', book.read("xl/workbook.xml").decode())
    for i, name in enumerate(names, 1):
        rows = []
        for r in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).iter():
            if r.tag.rpartition("}")[2] == "row" and len(rows) < TABLE_ROWS:
                values = []
                for c in r:
                    v = "".join(x.text or "" for x in c.iter() if x.tag.rpartition("}")[2] in ("v", "t"))
                    values.append(shared[int(v)] if c.get("t") == "s" and v else v)
                rows.append(values)
        yield name, rows


# Formats of bytes that need a converter.
BINARY = frozenset("pdf doc ppt pptx xls odt".split())


def needs_converter(name: str, data: bytes) -> bool:
    """Is this a file whose bytes are no text, and that no parser here reads?"""
    return name.rpartition(".")[2].lower() in BINARY and b"\0" in data[:4096] or data[:5] == b"%PDF-"


def parse(name: str, data: bytes) -> list[str]:
    """The pages of one file; formats without a parser here are decoded as text, but not those that need a converter."""
    kind = name.rpartition(".")[2].lower()
    if needs_converter(name, data):
        return []
    try:
        if kind in ("html", "htm"):
            p = _Text()
            p.feed(data.decode("utf-8", "replace"))
            return ["\n".join(p.parts).strip()]
        if kind == "csv":
            rows = list(csv.reader(io.StringIO(data.decode("utf-8", "replace"))))[:TABLE_ROWS]
            return [markdown_table(rows) or "(empty)"]
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return ["\n".join(t for t in _xml_texts(z.read("word/document.xml"), "p", "t") if t.strip())]
        if kind == "xlsx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [f"## {sheet}\n\n{markdown_table(rows) or '(empty)'}" for sheet, rows in _sheets(z)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, csv.Error):
        pass  # a broken file is still text
    text = data.decode("utf-8", "replace")
    return [p for p in text.split("\f") if p.strip()] or [""] if kind == "pdf" else [text]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, title, page_no, text, error of every file below a folder.  One file is one row, so a file has to fit a task.

    A file that needs a converter is one row without text that says so in ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                pages = [(t, None) for t in parse(p, bytes(data))] or [(None, "needs a converter")]
                rows += [(p, i, *x) for i, x in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"])

    return files.mapInPandas(run, "path string, page_no int, text string, error string").withColumn("title", T.stem(F.col("path")))

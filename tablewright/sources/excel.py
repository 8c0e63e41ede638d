"""Workbooks (.xlsx: a zip of XML parts) as rows, one task per workbook."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.text import distinct_names

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats of the file format that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _sheet_rows(content: bytes) -> Iterator[list[tuple[str, str] | None]]:
    """Rows of the first sheet; a cell is ``(kind, text)`` with kind n, s, b or d."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        workbook = ET.fromstring(book.read("xl/workbook.xml"))
        link = workbook.find(f"{_MAIN}sheets/{_MAIN}sheet").get(f"{_REL}id")
        props = workbook.find(f"{_MAIN}workbookPr")
        from_1904 = props is not None and props.get("date1904") in ("1", "true")
        epoch = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
        rels = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == link)
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        date_styles: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(book.read("xl/styles.xml"))
            custom = {
                int(f.get("numFmtId"))
                for f in styles.iter(f"{_MAIN}numFmt")
                if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))
            }
            formats = styles.find(f"{_MAIN}cellXfs")
            for i, xf in enumerate(formats if formats is not None else []):
                if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom:
                    date_styles.add(i)
        with book.open(part) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[tuple[str, str] | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    place = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r", "")).group():
                        place = place * 26 + ord(letter) - 64
                    while place and len(cells) < place - 1:
                        cells.append(None)
                    cells.append(_cell(cell, shared, date_styles, epoch))
                yield cells
                row.clear()


def _cell(cell: ET.Element, shared: list[str], date_styles: set[int], epoch: dt.datetime) -> tuple[str, str] | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "s", "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or not value.text or kind == "e":
        return None
    if kind == "s":
        return "s", shared[int(value.text)]
    if kind == "b":
        return "b", "true" if value.text == "1" else "false"
    if kind == "d":
        return "d", value.text.replace("T", " ")
    if kind == "str":
        return "s", value.text
    if int(cell.get("s", 0)) in date_styles:
        moment = epoch + dt.timedelta(milliseconds=round(float(value.text) * 86400000))
        return "d", moment.isoformat(sep=" ")
    return "n", value.text


def _read_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            chunk: list[tuple] = []
            for number, cells in enumerate(_sheet_rows(bytes(content))):
                kinds = [c[0] if c else None for c in cells]
                texts = [c[1] if c else None for c in cells]
                chunk.append((path, number, kinds, texts))
                if len(chunk) == 4096:
                    yield pd.DataFrame(chunk, columns=["path", "row_no", "kinds", "texts"])
                    chunk = []
            if chunk:
                yield pd.DataFrame(chunk, columns=["path", "row_no", "kinds", "texts"])


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of a workbook (or of all workbooks of a folder with the same header)."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    cells = books.mapInPandas(_read_books, "path string, row_no long, kinds array<string>, texts array<string>")
    cells = cells.where(F.exists("kinds", lambda k: k.isNotNull()))
    first = cells.where("row_no = 0").select("texts").first()
    if first is None:
        raise ValueError(f"No header row in {path}")
    header = distinct_names([t or "" for t in first["texts"]])
    body = cells.where("row_no > 0")
    stats = []
    for i in range(len(header)):
        kind, text = F.get("kinds", F.lit(i)), F.get("texts", F.lit(i))
        stats += [
            F.count(text).alias(f"n{i}"),
            *[F.count_if(kind == k).alias(f"{k}{i}") for k in ("d", "b")],
            F.count_if(kind == "n").alias(f"num{i}"),
            F.count_if((kind == "n") & text.rlike(r"^[+-]?[0-9]{1,18}$")).alias(f"int{i}"),
        ]
    seen = body.agg(*stats).first()
    out = []
    for i, name in enumerate(header):
        text, n = F.get("texts", F.lit(i)), seen[f"n{i}"]
        if n == seen[f"num{i}"]:
            text = text.cast("bigint" if n and n == seen[f"int{i}"] else "double")
        elif n == seen[f"d{i}"]:
            text = text.cast("timestamp_ntz")
        elif n == seen[f"b{i}"]:
            text = text.cast("boolean")
        out.append(text.alias(name))
    return body.select(*out)

"""Workbooks (.xlsx): each file is read in its own task; rows of the chosen sheets become columns by position."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from flowloom.operators.rows import Flows
from flowloom.plans.schema import Field
from flowloom.sources.files import typed


def _column(reference: str) -> int:
    number = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def sheet_rows(data: bytes, sheets: str | None, first: int, width: int) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number from 1, cells) of the sheets whose name matches the expression, all without one."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter() if _local(t) == "t") for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
        name = sheet.get("name")
        if sheets and not re.fullmatch(sheets, name):
            continue
        link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
        target = links[link].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if _local(row) != "row":
                    continue
                cells = [""] * width
                for c in row:
                    at = _column(c.get("r")) - first
                    if 0 <= at < width:
                        text = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                        cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                yield name, int(row.get("r")), cells
                row.clear()


def read_workbooks(spark: SparkSession, path: str, fields: list[Field], sheets: str | None = None, header: int = 1, first_column: int = 1, stop_on_empty_row: bool = False, trim: bool = True) -> Flows:
    """Rows of workbooks as typed columns; the first `header` rows of a sheet are skipped. reject has rows with text that can't be converted."""
    names = [f.name for f in fields]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for data in x["content"]:
                rows, ended = [], set()
                for sheet, number, cells in sheet_rows(bytes(data), sheets, first_column - 1, len(names)):
                    cells = [c.strip() for c in cells] if trim else cells
                    if number <= header or sheet in ended:
                        continue
                    if any(cells):
                        rows.append(cells)
                    elif stop_on_empty_row:
                        ended.add(sheet)
                yield pd.DataFrame(rows, columns=names)

    text: DataFrame = spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, ", ".join(f"`{n}` string" for n in names))
    return typed(text, fields)

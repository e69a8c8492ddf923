"""Sheets of an .xlsx workbook as grids, through Spark's Python data source interface; only the standard library.

``spark.read.format("workbook").option("sheet", name).load(path)`` gives ``row_id, label, m1 .. m12`` as strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql.datasource import DataSource, DataSourceReader

SCHEMA = "row_id int, label string, " + ", ".join(f"m{i} string" for i in range(1, 13))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple]:
    """Rows of a sheet as (row number, thirteen cells); cells that are not there are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = None
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(s.tag) == "sheet" and s.get("name") == sheet:
                target = links[next(v for k, v in s.attrib.items() if _local(k) == "id")]
        if target is None:
            raise ValueError(f"no sheet {sheet!r}")
        for row in ET.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter():
            if _local(row.tag) != "row":
                continue
            cells: list[str | None] = [None] * 13
            for c in row:
                name = re.match(r"[A-Z]+", c.get("r", ""))
                if name is None:
                    continue
                col = 0
                for letter in name[0]:
                    col = col * 26 + ord(letter) - 64
                text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                if 1 <= col <= 13 and text:
                    cells[col - 1] = shared[int(text)] if c.get("t") == "s" else text
            yield int(row.get("r", 0)), *cells


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet", "Monthly Data")

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:  # one small file; on a cluster it lies on a shared mount
            yield from sheet_rows(f.read(), self.sheet)


def read_sheet(spark, path: str, sheet: str = "Monthly Data"):
    """The same rows through Spark's own file readers, for stores that only these reach."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(sheet_rows(bytes(content), sheet)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def register(spark) -> None:
    spark.dataSource.register(Workbook)

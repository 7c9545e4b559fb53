"""Spreadsheet files: the first sheet of a workbook as rows of text."""
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def first_sheet(book: bytes):
    """Rows of the first sheet as lists of text; cells left out are empty."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        names = set(z.namelist())
        sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        path = targets[sheet.get(LINK)]
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(MAIN + "si")]
        for row in ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else "xl/" + path)).iter(MAIN + "row"):
            cells = []
            for cell in row.iter(MAIN + "c"):
                letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    at -= 1
                value = cell.find(MAIN + "v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                elif cell.get("t") == "s":
                    text = shared[int(value.text)]
                else:
                    text = value.text or "" if value is not None else ""
                cells += [""] * (at - len(cells)) + [text]
            yield cells


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0), cells of the first sheet of each workbook; one task opens one workbook at a time."""
    def run(batches):
        for pdf in batches:
            for name, book in zip(pdf["path"], pdf["content"]):
                rows = list(first_sheet(book))
                yield pd.DataFrame({"path": [name] * len(rows), "row": range(len(rows)), "cells": rows})
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def read_xlsx(spark: SparkSession, path: str, marker: str | None = None) -> DataFrame:
    """The first sheet by its header: the first row, or with marker the first that has a cell of that text.

    Cells that a row lacks are empty; rows without any text are dropped. All workbooks of path need one header."""
    rows = read_rows(spark, path)
    heads = rows.where(F.array_contains("cells", marker) if marker else F.col("row") == 0)
    heads = heads.groupBy("path").agg(F.min(F.struct("row", "cells")).alias("head"))
    names = [r[0] for r in heads.select("head.cells").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("the workbooks must have one header")
    body = rows.join(F.broadcast(heads), "path").where(F.col("row") > F.col("head.row")).where(F.array_join("cells", "") != "")
    return body.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names[0]) if n))

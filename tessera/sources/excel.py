"""Excel workbooks (.xlsx) as a bulk Spark source.

``binaryFile`` lists the workbooks (one row per file, so many workbooks are
read in parallel); ``mapInPandas`` opens each with the standard library
(``zipfile`` + XML), reads the first sheet and emits one row per sheet row;
the header row becomes the column names and values go through the same
missing-token and type inference as CSV.  A single workbook is one task —
an .xlsx file is a zip archive and cannot be split.  Legacy binary .xls is
not supported.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import infer_types, normalize_missing

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def parse_first_sheet(data: bytes) -> list[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", _NS)
        target = "xl/worksheets/sheet1.xml"
        if first is not None and "xl/_rels/workbook.xml.rels" in z.namelist():
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            rid = first.get(_REL)
            for r in rels:
                if r.get("Id") == rid:
                    t = r.get("Target").lstrip("/")
                    target = t if t.startswith("xl/") else f"xl/{t}"
        sheet = ET.fromstring(z.read(target))
    rows: list[list[str | None]] = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            t, v = c.get("t"), c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            elif t == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text if v is not None else None
            cells[_col_index(c.get("r"))] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def _header_names(cells: list[str | None]) -> list[str]:
    """Column names as the pandas reader gives them: blanks are numbered, repeats get a suffix."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(cells):
        name = h if h is not None else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _explode_sheets(batches):
    """One row per sheet row: its cells by the names of its own workbook's header."""
    import pandas as pd

    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = parse_first_sheet(bytes(content))
            width = max(map(len, rows), default=0)
            names = _header_names([*rows[0], *[None] * (width - len(rows[0]))]) if rows else []
            out += [(path, i, names, dict(zip(names, cells))) for i, cells in enumerate(rows)]
        yield pd.DataFrame(out, columns=["path", "row_idx", "names", "cells"])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks under ``path``; columns are the union of their headers, in the order of file and place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content")
    rows = files.mapInPandas(_explode_sheets, "path string, row_idx long, names array<string>, cells map<string,string>")
    headers = rows.where("row_idx = 0").select("path", F.posexplode("names").alias("place", "name"))
    first = headers.groupBy("name").agg(F.min(F.struct("path", "place")).alias("first")).orderBy("first").collect()  # one row a column
    if not first:
        raise ValueError("File contains no data.")
    body = rows.where("row_idx > 0").select(*[F.col("cells")[r["name"]].alias(r["name"]) for r in first])
    return infer_types(normalize_missing(body))

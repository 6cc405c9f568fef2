"""Workbooks (xlsx) read and written with the standard library: sheets as text, as tables by position, and ordered exports."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.numbers import to_number
from parcelforge.functions.text import blank

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Most rows of a workbook's sheet.
MAX_ROWS = 1_048_576


def column_number(reference: str) -> int:
    """0 for ``A7``, 27 for ``AB1``."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> list[tuple[str, list[tuple[int, list[str]]]]]:
    """(name, [(row number, cells as text)]) of every sheet; [] for bytes that are no workbook."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        out = []
        for s in book.find("m:sheets", _NS):
            path = targets[s.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            rows = []
            for r in root.iter(f"{{{_NS['m']}}}row"):
                cells: list[str] = []
                for c in r.findall("m:c", _NS):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else v.text
                rows.append((int(r.get("r") or len(rows) + 1), cells))
            out.append((s.get("name"), rows))
        return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, TypeError):
        return []


def as_text(data: bytes) -> str:
    """All sheets: a header line each, then the cells of non-empty rows between bars."""
    parts = []
    for name, rows in sheets(data):
        lines = [" | ".join(x for x in cells if x.strip()) for _, cells in rows]
        parts.append("\n".join([f"--- Sheet: {name} ---", *(x for x in lines if x)]))
    return "\n\n".join(parts)


def workbook_texts(files: DataFrame) -> DataFrame:
    """(path, text) of workbooks; ``files`` as read by ``binaryFile``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(x.as_py() or b"") for x in b.column(1)], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def workbook_table(spark: SparkSession, path: str, sheet: str, columns: dict[str, str], header_row: int = 1, first_column: int = 0, key: str | None = None) -> DataFrame:
    """Rows of one sheet below ``header_row``, columns by position from ``first_column``; ``row`` is the sheet's row; numbers are read out of pound signs and commas, zero as missing; rows whose ``key`` is blank are skipped."""
    names = list(columns)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = next((r for n, r in sheets(content.as_py() or b"") if n == sheet), [])
                rows = [(n, cells[first_column : first_column + len(names)]) for n, cells in rows if n > header_row]
                cols = [[(c[i] if i < len(c) and c[i] != "" else None) for _, c in rows] for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int32()), *(pa.array(c, pa.string()) for c in cols)], ["row", *names])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row int, " + ", ".join(f"`{n}` string" for n in names))
    typed = {"DOUBLE": lambda n: to_number(n), "INT": lambda n: to_number(n).cast("int"), "STRING": F.col}
    out = raw.select("row", *(typed[t](n).alias(n) for n, t in columns.items()))
    return out.where(~blank(key)) if key else out


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", str(value)))}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def write_workbook(df: DataFrame, path: str, sheet: str, columns: list[str], headers: list[str] | None = None, order: str | None = None) -> int:
    """An export of at most a sheet's rows, written by the driver row by row; returns the number of rows.  Larger tables are refused: export them as CSV."""
    out = df.orderBy(order) if order else df
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            put = lambda s: f.write(s.encode("utf-8"))
            put(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData><row>' + "".join(map(_cell, headers or columns)) + "</row>")
            for r in out.select(*columns).toLocalIterator():
                n += 1
                if n >= MAX_ROWS:
                    raise ValueError(f"a sheet holds at most {MAX_ROWS} rows")
                put("<row>" + "".join(map(_cell, r)) + "</row>")
            put("</sheetData></worksheet>")
    return n

"""Text of brochures by kind of file; PDF needs one of two libraries that may not be installed, and gives '' without."""

from __future__ import annotations

import io
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import shortened
from parcelforge.sources.files import kind_of
from parcelforge.sources.workbook import as_text

#: Letters below which a PDF's text is too little to work with, and that a model is given at most.
LEAST, MOST = 100, 60_000


def pdf_text(data: bytes) -> str:
    """Pages with their numbers; '' where no PDF library is installed or the file can not be read."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            pages = [p.extract_text() or "" for p in pdf.pages]
    except ImportError:
        try:
            import fitz

            pages = [p.get_text() for p in fitz.open(stream=data, filetype="pdf")]
        except ImportError:
            return ""
    except Exception:  # noqa: BLE001 - broken files are no text
        return ""
    return "\n\n".join(f"--- Page {i} ---\n{t}" for i, t in enumerate(pages, 1) if t.strip())


READERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_text, "sheet": as_text}


def document_texts(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, kind, text, route) of files as read by ``binaryFile``: ``text`` by the reader of its kind, and whether it is to be read as text, as page images or not at all."""
    readers = readers or READERS

    def run(batches):
        for b in batches:
            texts = [readers[k](c or b"") if k in readers else "" for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["path", "kind", "text"])

    out = files.select("path", kind_of(F.col("path")).alias("kind"), "content").mapInArrow(run, "path string, kind string, text string")
    return out.withColumn("route", route(F.col("kind"), F.col("text"))).withColumn("text", shortened("text", MOST, "\n[cut]"))


def route(kind: Column, text: Column) -> Column:
    """``text`` where there is enough of it, ``images`` for PDFs with too little, else ``none``."""
    enough = F.length(F.trim(text)) >= LEAST
    return F.when(enough, "text").when(kind == "pdf", "images").when((kind == "sheet") & (F.trim(text) != ""), "text").otherwise("none")

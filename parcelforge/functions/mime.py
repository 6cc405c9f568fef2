"""Bodies and attachment names of mail payloads (nested parts as JSON)."""

from __future__ import annotations

import base64
import json
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decode(data: str) -> str:
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", errors="replace") if data else ""


def _leaves(part: dict):
    yield part
    for p in part.get("parts") or []:
        yield from _leaves(p)


def html_text(html: str) -> str:
    """Plain text of simple HTML, as ``functions.text.html_text`` gives it."""
    s = re.sub(r"<p[^>]*>", "\n\n", re.sub(r"<br\s*/?>", "\n", html, flags=re.I), flags=re.I)
    s = re.sub(r"<[^>]+>", "", s).replace("&nbsp;", " ").replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"&#\d+;", "", s)).strip()


def bodies(payload: str | None) -> tuple[str, str, list[str]]:
    """(first plain text, all plain texts, attachment names) of a payload; HTML stands in where no plain text is."""
    try:
        parts = list(_leaves(json.loads(payload or "{}")))
    except ValueError:
        return "", "", []
    texts = lambda kind: [t for p in parts if p.get("mimeType") == kind and (t := _decode((p.get("body") or {}).get("data") or ""))]
    plain, html = texts("text/plain"), texts("text/html")
    names = [p["filename"] for p in parts if p.get("filename")]
    if plain:
        return plain[0], "\n\n".join(plain), names
    return (re.sub(r"<[^>]+>", " ", html[0]), html_text(html[0]), names) if html else ("", "", names)


@F.arrow_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("full", T.StringType()), T.StructField("files", T.ArrayType(T.StringType()))]))
def mail_bodies(payload: pa.Array) -> pa.Array:
    kind = pa.struct([("first", pa.string()), ("full", pa.string()), ("files", pa.list_(pa.string()))])
    return pa.array([dict(zip(("first", "full", "files"), bodies(p))) for p in payload.to_pylist()], kind)

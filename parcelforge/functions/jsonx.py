"""JSON out of model replies: fences, chatter around it, strings and escapes."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unfenced(text: str) -> str:
    """What stands between code fences, if anything does."""
    if "```" not in text:
        return text
    inside, kept = False, []
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            inside = not inside
        elif inside:
            kept.append(line)
    return "\n".join(kept) if kept else text


def balanced(text: str, start: int) -> str | None:
    """The bracketed stretch that begins at ``start``, strings and escapes heeded."""
    closing = {"{": "}", "[": "]"}
    stack, quoted, i = [], False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in closing:
            stack.append(closing[c])
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[start : i + 1]
        i += 1
    return None


def recover(text: str | None, openers: str = "{[") -> str | None:
    """The first JSON object (or array, if ``openers`` says so) of a reply, in canonical form; null if there is none."""
    if text is None:
        return None
    text = unfenced(text)
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        pass
    at = min((i for o in openers if (i := text.find(o)) >= 0), default=-1)
    part = balanced(text, at) if at >= 0 else None
    try:
        return json.dumps(json.loads(part), ensure_ascii=False) if part else None
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def recover_json(text: pa.Array) -> pa.Array:
    return pa.array([recover(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def recover_object(text: pa.Array) -> pa.Array:
    return pa.array([recover(t, "{") for t in text.to_pylist()], pa.string())

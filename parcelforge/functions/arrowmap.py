"""Scalar Python functions over Arrow columns, computed once for each different value."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

#: Different values that a worker remembers for each function before it forgets them all.
REMEMBERED = 300_000
_memo: dict[str, dict] = {}


def mapped(column: pa.Array, f, name: str, kind: pa.DataType | None = None) -> pa.Array:
    """``f`` of every value (of null too), each different value computed once per worker; ``name`` names the memory."""
    kind = kind or pa.string()
    known = _memo.setdefault(name, {})
    if len(known) > REMEMBERED:
        known.clear()
    coded = pc.dictionary_encode(column, null_encoding="encode")
    words = []
    for w in coded.dictionary.to_pylist():
        if w not in known:
            known[w] = f(w)
        words.append(known[w])
    return pa.array(words, kind).take(coded.indices) if words else pa.nulls(len(column), kind)

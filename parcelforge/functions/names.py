"""Keys for deal names and occupier names that are written in many ways (plain Python, used inside Arrow stages)."""

from __future__ import annotations

import re

# Legal forms and other words of company names that carry no identity.
LEGAL = {"ltd", "limited", "plc", "llp", "llc", "inc", "co", "company", "holdings", "holding", "group", "uk", "the"}
#: Names that say that no occupier is known.
NO_NAME = {"", "confidential", "unknown", "n a", "na", "tbc", "tba", "none", "null", "private", "undisclosed", "vacant"}
# Numerals of estate phases.
PHASES = {"ii": "2", "two": "2", "iii": "3", "three": "3", "iv": "4", "one": "1", "i": "1"}

_QUARTER = re.compile(r"\(\s*\d{4}\s*q\d\s*\)|\(\s*q\d\s*\d{4}\s*\)")
_PARTS = re.compile(r",|\s-\s|\||;|\n|\s–\s")


def deal_key(text: str | None) -> str:
    """The parts of a deal name in lower case and sorted order, phases as digits, quarter suffixes dropped; '' for null."""
    s = _QUARTER.sub(" ", (text or "").lower().replace("\u00a0", " "))
    parts = []
    for part in _PARTS.split(s):
        words = re.sub(r"[^\w\s]", " ", part).split()
        for i in range(len(words) - 1):
            if words[i] in ("phase", "ph"):
                words[i : i + 2] = ["phase", PHASES.get(words[i + 1], words[i + 1])]
        if words:
            parts.append(" ".join(words))
    return ", ".join(sorted(parts))


def occupier_key(text: str | None) -> str:
    """The words of an occupier's name that identify it; '' where none is named (null, blank, confidential, vacant)."""
    s = (text or "").lower().replace("\u00a0", " ")
    s = re.split(r"\bt/a\b|\btrading as\b", s)[0]
    words = [w for w in re.sub(r"[^\w\s]", " ", s).split() if w not in LEGAL]
    if not words or words[0] == "vacant" or " ".join(words) in NO_NAME:
        return ""
    return " ".join(words)

"""Free-text premises addresses to parts: unit, building number, street, estate, town, postcode.

``AddressReader`` is built once per worker from the (small, fixed) place table and reads one
address in a single pass over its comma-, bar-, semicolon-, dash- or line-separated segments.
Null and blank addresses give an empty reading; nothing raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Street types and how they are abbreviated.
STREET_TYPES = {
    "avenue": ["avenue", "ave", "av", "avn"],
    "close": ["close", "cl", "clo"],
    "court": ["court", "ct", "crt"],
    "crescent": ["crescent", "cres", "cr", "cresc"],
    "drive": ["drive", "dr", "drv"],
    "gardens": ["gardens", "gdns", "gdn"],
    "grove": ["grove", "gr", "grv"],
    "hill": ["hill"],
    "lane": ["lane", "ln", "la"],
    "parade": ["parade", "pde"],
    "place": ["place", "pl"],
    "road": ["road", "rd"],
    "square": ["square", "sq"],
    "street": ["street", "st", "str"],
    "terrace": ["terrace", "ter", "terr"],
    "walk": ["walk", "wlk"],
    "way": ["way", "wy"],
}
# Words of estate names and how they are abbreviated.
ESTATE_WORDS = {
    "i/e": "industrial estate", "t/e": "trading estate", "r/park": "retail park", "b/park": "business park", "b.p.": "business park", "d.c.": "distribution centre",
    "bp": "business park", "dc": "distribution centre", "ind": "industrial", "indl": "industrial", "est": "estate", "trdg": "trading", "trad": "trading", "pk": "park", "bus": "business",
    "comm": "commercial", "ctr": "centre", "dist": "distribution", "distribution": "distribution", "log": "logistics", "ent": "enterprise", "wks": "works", "ph": "phase", "ii": "2", "two": "2", "iii": "3", "three": "3", "one": "1",
}
# Last words that mark an estate name.
ESTATE_LAST = {"estate", "park", "centre", "works"}
COUNTRIES = {"uk", "england", "united kingdom", "gb", "great britain", "u.k."}
#: What stands for a missing value in text columns.
PLACEHOLDERS = {"", "-", "--", "n/a", "na", "none", "null", "nil", "tbc", "tba", "unknown", "?", "??", "nan", "not known", "multiple", "various"}

POSTCODE = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?)\s*(\d[a-z]{2})\b")
OUTCODE = re.compile(r"^([a-z]{1,2}\d{1,2}[a-z]?)$")
_TYPE = {a: t for t, names in STREET_TYPES.items() for a in names}
_LONG_TYPES = [t for t in STREET_TYPES if len(t) >= 4]
_NUMBER = r"\d{1,4}\s?[a-z]?(?![a-z\d])"
_RANGE = re.compile(r"(?<!phase )(?<!ph )(?<!ph\. )(?<![\w.])(\d{1,4}[a-z]?)\s*(?:-|–|—|/|to)\s*(\d{1,4}[a-z]?)(?![\w/])")
_UNIT = re.compile(r"(?:\b(?:units?|un|suite|plot|bay)\b\s*[.:]?\s*(?:no\b\s*[.:]?\s*)?[.:]?\s*|\bu(?=\d))([a-z]?\d{1,3}[a-z]?|[a-z])\b(?![-/]\d)")
_UNIT_ONLY = re.compile(r"u\s?([a-z]\d{0,3}|\d{1,3}[a-z]?)$")
_NO = re.compile(r"^(?:nos?|number)\b\s*[.:]?\s*(?=\d)")
_LEAD = re.compile(rf"^({_NUMBER}(?:-\d{{1,4}}[a-z]?)?)\s*(.*)$")
_NUMBER_ONLY = re.compile(r"^\d{1,4}\s?[a-z]?(?:-\d{1,4}[a-z]?)?$")
_SEG = re.compile(r"\s*[,;|\n\r\t]+\s*|\s+-\s+|\s+-(?=\S)(?!\d)|(?<=\D)-\s+")
_BRACKET = re.compile(r"\((?!ph)[^)]*\)")


def clean_postcode(text: str | None) -> str:
    """``AB12 3CD`` in capitals with one space, or '' where no full postcode is found."""
    m = POSTCODE.search((text or "").lower())
    return f"{m[1]} {m[2]}".upper() if m else ""


def is_missing(text: str | None) -> bool:
    return text is None or text.replace("\u00a0", " ").strip().strip(".").lower() in PLACEHOLDERS


def unit_code(text: str | None) -> str:
    """``Unit No. 05``, ``U5`` and ``un. 5`` give ``5``; '' where there is no unit."""
    if is_missing(text):
        return ""
    s = " ".join(text.replace("\u00a0", " ").lower().split())
    m = _UNIT.search(s) or _UNIT_ONLY.match(s) or re.match(r"([a-z]?\d{1,3}[a-z]?|[a-z])$", s)
    return (m[1].lstrip("0") or "0") if m else ""


def deletions(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most + 1`` where it is larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


class Speller:
    """Nearest word of a small vocabulary, by a dictionary of one-letter deletions."""

    def __init__(self, words):
        self.words, self.keys = set(words), {}
        for w in sorted(self.words):
            for k in deletions(w):
                self.keys.setdefault(k, []).append(w)
        self.longest = max(map(len, self.words), default=0)
        self.memo = {}

    def nearest(self, word: str) -> str | None:
        if word in self.words:
            return word
        if len(word) > self.longest + 1:  # no common deletion
            return None
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = sorted((distance(word, w, 2), w) for w in {w for k in deletions(word) for w in self.keys.get(k, ())})
            best = [w for d, w in found if d == found[0][0] and d <= (2 if len(word) > 6 else 1)]
            self.memo[word] = best[0] if len(best) == 1 else None
        return self.memo[word]


@dataclass
class Reading:
    """Parts of one address; '' where absent; the estate as it is written."""

    unit: str = ""
    number: str = ""
    street: str = ""
    street_type: str = ""
    estate: str = ""
    town: str = ""
    postcode: str = ""
    outcode: str = ""
    towns: list[str] = field(default_factory=list)


def estate_name(text: str) -> str:
    """Estate name with words written out; ``x industrial estate 2`` for a second phase."""
    s = re.sub(r"[()\"]", " ", text.lower())
    words = []
    for w in s.replace(" - ", " ").split():
        w = ESTATE_WORDS.get(w) or ESTATE_WORDS.get(w.strip(".:")) or w.strip(".:")
        words += w.split()
    return " ".join(w for w in words if w != "phase")


class AddressReader:
    """``places``: (name, county, outcode) rows of the place table."""

    def __init__(self, places):
        self.town_of = {(o or "").lower(): n for n, _, o in places if o}
        self.towns = {n.lower(): n for n, _, _ in places if n}
        self.counties = {(c or "").lower() for _, c, _ in places if c}
        self.speller = Speller([*self.towns, *self.counties])
        self.types = Speller(_LONG_TYPES)
        self.memo: dict[str, tuple] = {}
        self.columns: dict[str | None, tuple] = {}
        self.codes: dict[str | None, tuple[str, str]] = {}

    def place(self, words: str) -> tuple[str, str] | None:
        """('town', name) or ('county', name) where ``words`` name one, however spelt."""
        if any(c.isdigit() for c in words):
            return None
        for lead in ("nr ", "near ", "nr. "):
            words = words.removeprefix(lead)
        w = self.speller.nearest(words.replace(" ", "")) if words else None
        return None if w is None else ("town", self.towns[w]) if w in self.towns else ("county", w)

    def type_of(self, word: str) -> str | None:
        w = word.strip(".")
        return _TYPE.get(w) or (self.types.nearest(w) if len(w) > 3 else None)

    def segment(self, seg: str) -> tuple[tuple[str, str], ...]:
        """The parts of one segment without unit and postcode, as (kind, text)."""
        got = self.memo.get(seg)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[seg] = self._segment(seg)
        return got

    def _segment(self, seg: str):
        out, rest = [], _NO.sub("", seg)
        if _NUMBER_ONLY.match(rest):
            return (("number", rest.replace(" ", "")),)
        if m := _LEAD.match(rest):
            out.append(("number", m[1].replace(" ", "")))
            rest = m[2].strip(" .")
        elif m := re.match(r"^(.*\S)\s+(?:nos?\b\.?\s*)?(\d{1,4}[a-z]?(?:-\d{1,4}[a-z]?)?)$", rest):
            if self.type_of(m[1].split()[-1]):
                out.append(("number", m[2]))
                rest = m[1]
        if not rest or rest in COUNTRIES:
            return tuple(out)
        if not out and (p := self.place(rest)):
            return (p,)
        words = rest.split()
        if words[0].startswith("land") and len(words) > 2 and words[1] == "at":
            words = words[2:]
        last = words[-1].strip(".")
        named = ESTATE_WORDS.get(last, last).split()[-1]
        if not out and (named in ESTATE_LAST or named.isdigit()):
            return (("estate", rest),)
        cut = len(words) if self.type_of(words[-1]) and len(words) > 1 else 0
        if not cut and len(words) > 2:  # a town or county may follow the street without a comma
            for k in range(len(words) - 1, 1, -1):
                if self.type_of(words[k - 1]) and (p := self.place(" ".join(words[k:]))):
                    out.append(p)
                    cut = k
                    break
        if cut:
            return (*out, ("street", " ".join(words[: cut - 1]).replace("'", "")), ("type", self.type_of(words[cut - 1])))
        return (*out, ("street" if out else "estate", " ".join(words) if out else rest))

    def read(self, address: str | None) -> Reading:
        r = Reading()
        if is_missing(address):
            return r
        s = address.lower().replace("\u00a0", " ").replace("–", "-").replace("—", "-")
        if "(" in s:
            s = _BRACKET.sub(" ", s)
        if m := POSTCODE.search(s):
            r.outcode, r.postcode = m[1], f"{m[1]} {m[2]}".upper()
            s = s[: m.start()] + "," + s[m.end() :]
        if m := _UNIT.search(s):
            r.unit = m[1].lstrip("0") or "0"
            s = s[: m.start()] + "," + s[m.end() :]
        if "-" in s or "/" in s or "to" in s:
            s = _RANGE.sub(r"\1-\2", s)
        for seg in _SEG.split(s):
            seg = " ".join(seg.split()).strip(" .:")
            if not seg:
                continue
            if not r.unit and (m := _UNIT_ONLY.match(seg)):
                r.unit = m[1].lstrip("0") or "0"
                continue
            if (m := OUTCODE.match(seg)) and m[1] in self.town_of:
                r.outcode = r.outcode or m[1]
                continue
            for kind, text in self.segment(seg):
                if kind == "town":
                    r.towns.append(text)
                elif kind == "number" and not r.number:
                    r.number = text
                elif kind == "street" and not r.street:
                    r.street = text
                elif kind == "type" and not r.street_type:
                    r.street_type = text
                elif kind == "estate" and not r.estate:
                    r.estate = text
        if r.towns:
            r.town = r.towns[-1]
        return r

    def town_of_column(self, text: str | None) -> tuple:
        """((town, weight), ...) that a town column names."""
        got = self.columns.get(text)
        if got is None:
            if len(self.columns) > 100_000:
                self.columns.clear()
            found = []
            if not is_missing(text):
                for k, part in enumerate(re.split(r"[,/(]", " ".join(text.lower().replace("\u00a0", " ").split()))):
                    p = self.place(part.strip(" .)"))
                    if p and p[0] == "town":
                        found.append((p[1], 2 - k * 0.5))
            got = self.columns[text] = tuple(found)
        return got

    def code_of_column(self, text: str | None) -> tuple[str, str]:
        """(full postcode or '', town of its outcode or '') of a postcode column."""
        got = self.codes.get(text)
        if got is None:
            if len(self.codes) > 300_000:
                self.codes.clear()
            s = "" if is_missing(text) else " ".join(text.lower().replace("\u00a0", " ").split())
            m = POSTCODE.search(s)
            out = m or OUTCODE.match(s)
            got = self.codes[text] = (f"{m[1]} {m[2]}".upper() if m else "", self.town_of.get(out[1], "") if out else "")
        return got

    def towns_of(self, reading: Reading, town: str | None, postcode: str | None) -> tuple[str, str, float]:
        """(town, rival, lead): the towns that address, town column and postcode column together speak for most and next, or '', and by how many votes the first leads."""
        votes: dict[str, float] = {}
        for t in reading.towns:
            votes[t] = votes.get(t, 0) + 3
        if t := self.town_of.get(reading.outcode):
            votes[t] = votes.get(t, 0) + 4
        for t, w in self.town_of_column(town):
            votes[t] = votes.get(t, 0) + w
        if t := self.code_of_column(postcode)[1]:
            votes[t] = votes.get(t, 0) + 2.5
        if len(votes) < 2:
            return next(iter(votes), ""), "", 0.0
        best = max(votes, key=lambda t: (votes[t], t))
        next_ = max((t for t in votes if t != best), key=lambda t: (votes[t], t))
        return best, next_, votes[best] - votes[next_]

    def town(self, reading: Reading, town: str | None, postcode: str | None) -> str:
        """The town that address, town column and postcode column together speak for, or ''."""
        return self.towns_of(reading, town, postcode)[0]

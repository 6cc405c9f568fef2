"""Quantities in free text: a grammar of numbers and unit expressions.

A unit is a scale and an offset onto the canonical unit of its dimension, and a dimension is a
vector of exponents (length, mass, time, temperature).  ``parse_unit`` reads products, quotients
and powers (``sq m``, ``m²``, ``ft2``, ``square yards``, ``kg/m2``); ``quantities`` finds numbers
with units in a text, and units without number, each with the clause that it stands in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Name, (length, mass, time, temperature), scale to metres, kilograms, seconds, kelvin, offset.
BASE = {
    "m": ((1, 0, 0, 0), 1.0, 0.0, ["m", "metre", "metres", "meter", "meters", "mtr", "mtrs"]),
    "km": ((1, 0, 0, 0), 1000.0, 0.0, ["km", "kilometre", "kilometres", "kilometer", "kilometers"]),
    "cm": ((1, 0, 0, 0), 0.01, 0.0, ["cm", "centimetre", "centimetres"]),
    "mm": ((1, 0, 0, 0), 0.001, 0.0, ["mm", "millimetre", "millimetres"]),
    "ft": ((1, 0, 0, 0), 0.3048, 0.0, ["ft", "foot", "feet"]),
    "in": ((1, 0, 0, 0), 0.0254, 0.0, ["inch", "inches"]),
    "yd": ((1, 0, 0, 0), 0.9144, 0.0, ["yd", "yds", "yard", "yards"]),
    "mi": ((1, 0, 0, 0), 1609.344, 0.0, ["mile", "miles"]),
    "sqft": ((2, 0, 0, 0), 0.3048**2, 0.0, ["sqft", "sqfeet", "sf"]),
    "sqm": ((2, 0, 0, 0), 1.0, 0.0, ["sqm", "sqmetre", "sqmetres", "sqmeters", "sqmtr", "sqmtrs"]),
    "sqyd": ((2, 0, 0, 0), 0.9144**2, 0.0, ["sqyd", "sqyds", "sqyard", "sqyards"]),
    "acre": ((2, 0, 0, 0), 4840 * 0.9144**2, 0.0, ["acre", "acres", "ac"]),
    "ha": ((2, 0, 0, 0), 10_000.0, 0.0, ["ha", "hectare", "hectares"]),
    "l": ((3, 0, 0, 0), 0.001, 0.0, ["litre", "litres", "liter", "liters"]),
    "kg": ((0, 1, 0, 0), 1.0, 0.0, ["kg", "kilogram", "kilograms", "kilo", "kilos"]),
    "g": ((0, 1, 0, 0), 0.001, 0.0, ["gram", "grams"]),
    "t": ((0, 1, 0, 0), 1000.0, 0.0, ["tonne", "tonnes"]),
    "lb": ((0, 1, 0, 0), 0.45359237, 0.0, ["lb", "lbs", "pound", "pounds"]),
    "s": ((0, 0, 1, 0), 1.0, 0.0, ["second", "seconds"]),
    "min": ((0, 0, 1, 0), 60.0, 0.0, ["minute", "minutes", "mins"]),
    "h": ((0, 0, 1, 0), 3600.0, 0.0, ["hour", "hours", "hr", "hrs"]),
    "K": ((0, 0, 0, 1), 1.0, 0.0, ["kelvin"]),
    "degC": ((0, 0, 0, 1), 1.0, 273.15, ["°c", "degc", "celsius"]),
    "degF": ((0, 0, 0, 1), 5 / 9, 459.67 * 5 / 9, ["°f", "degf", "fahrenheit"]),
}
AREA = (2, 0, 0, 0)
_BY_WORD = {w: k for k, (_, _, _, words) in BASE.items() for w in words}
_THOUSAND = {"k", "000", "000s", "thousand", "thousands"}

_TOKEN = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|°[cf]\b|[a-zµ]+|[²³/*^×()%£:;\-'’]", re.I)
_NUM = re.compile(r"\d")


@dataclass(frozen=True)
class Unit:
    """``value * scale + offset`` is in canonical units (metres, kilograms, seconds, kelvin and their products)."""

    name: str
    dim: tuple[int, int, int, int]
    scale: float
    offset: float = 0.0

    def power(self, n: int) -> Unit:
        return self if n == 1 else Unit(f"{self.name}^{n}", tuple(e * n for e in self.dim), self.scale**n)

    def times(self, other: Unit, sign: int = 1) -> Unit:
        name = f"{self.name}{'*' if sign > 0 else '/'}{other.name}"
        return Unit(name, tuple(a + sign * b for a, b in zip(self.dim, other.dim)), self.scale * other.scale**sign)

    def canonical(self, value: float) -> float:
        return value * self.scale + self.offset

    def to(self, value: float, other: Unit) -> float:
        if self.dim != other.dim:
            raise ValueError(f"{self.name} and {other.name} measure different things")
        return (self.canonical(value) - other.offset) / other.scale


def unit(name: str) -> Unit:
    dim, scale, offset, _ = BASE[name]
    return Unit(name, dim, scale, offset)


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("sq.", "sq ").replace(".m.", " m "))


def _factor(t: list[str], i: int) -> tuple[Unit | None, int]:
    """factor := ('sq' | 'square' | 'cubic') base | base power?"""
    if i < len(t) and t[i] in ("sq", "square", "cubic", "cu") and i + 1 < len(t) and t[i + 1] in _BY_WORD:
        base = unit(_BY_WORD[t[i + 1]])
        return (base.power(3 if t[i][0] == "c" else 2), i + 2) if base.dim == (1, 0, 0, 0) else (None, i)
    if i >= len(t) or t[i] not in _BY_WORD:
        return None, i
    base, i = unit(_BY_WORD[t[i]]), i + 1
    if i < len(t) and t[i] in ("²", "³", "2", "3") and base.dim == (1, 0, 0, 0):
        return base.power(3 if t[i] in "³3" else 2), i + 1
    if i + 1 < len(t) and t[i] == "^" and t[i + 1].isdigit():
        return base.power(int(t[i + 1])), i + 2
    return base, i


def _expression(t: list[str], i: int) -> tuple[Unit | None, int]:
    """expression := factor (('*' | '/') factor)*"""
    u, i = _factor(t, i)
    while u is not None and i < len(t) and t[i] in "*/×":
        v, j = _factor(t, i + 1)
        if v is None:
            break
        u, i = u.times(v, -1 if t[i] == "/" else 1), j
    return u, i


def parse_unit(text: str) -> Unit | None:
    """The unit that the whole of ``text`` names, else None."""
    t = _tokens(text)
    u, i = _expression(t, 0)
    return u if u is not None and i == len(t) else None


@dataclass(frozen=True)
class Quantity:
    """``value`` is None for a unit that stands without number; ``clause`` is the text between semicolons around it."""

    value: float | None
    thousands: bool
    unit: Unit
    clause: str


def quantities(text: str | None) -> list[Quantity]:
    """All numbers with units, and units without number, in order; [] for null and blank texts."""
    out = []
    for clause in re.split(r"[;\n]", text or ""):
        t = _tokens(clause)
        i = 0
        while i < len(t):
            if _NUM.match(t[i]) and not (i and t[i - 1] in ("'", "’")) and t[i] not in ("000",):
                j, thousands = i + 1, False
                if j < len(t) and t[j] in ("k", "thousand"):
                    j, thousands = j + 1, True
                if j < len(t) and t[j] == "-":
                    j += 1
                u, k = _expression(t, j)
                if u is not None:
                    out.append(Quantity(float(t[i].replace(",", "")), thousands, u, clause))
                    i = k
                    continue
                i += 1
                continue
            thousands = t[i] in _THOUSAND or (t[i] in ("'", "’") and i + 1 < len(t) and t[i + 1] == "000")
            j = i
            while thousands and j < len(t) and (t[j] in _THOUSAND or t[j] in ("'", "’", "s", "of")):
                j += 1
            u, k = _expression(t, j)
            if u is not None:
                out.append(Quantity(None, thousands, u, clause))
                i = k
            else:
                i += 1
        if not out and re.search(r"\bmetric\b", clause, re.I):
            out.append(Quantity(None, False, unit("sqm"), clause))
    return out

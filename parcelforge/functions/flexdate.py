"""Free-text dates and times to one unambiguous form.

``day_of`` gives the UK calendar day of a value, ``instant_of`` the UTC instant.
Rules: day before month in all-numeric dates that do not begin with the year; two-digit
years are of this century; zone-less times are clock times of ``zone``, the earlier one
where the clock shows them twice; local times that the clock skips and days that do not
exist give None.  Months, quarters and years stand for their first day (``day_of`` only).
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

UTC = timezone.utc
UK = "Europe/London"

# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Offsets, in minutes, of zone abbreviations.
ZONES = {"z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
         "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
# Ordinal words of quarters.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4}

_MONTH = {m[:k]: i + 1 for i, m in enumerate(MONTHS) for k in (3, len(m))} | {"sept": 9}
_MON = "|".join(sorted(_MONTH, key=len, reverse=True))
_DOW = r"(?:mon|tue|tues|wed|weds|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+"
_DATE = "|".join(
    [
        r"(?P<y1>\d{4})\s*[-/.]\s*(?P<m1>\d{1,2})\s*[-/.]\s*(?P<d1>\d{1,2})",
        r"(?P<y2>(?:19|20)\d{2})(?P<m2>\d{2})(?P<d2>\d{2})(?!\d)",
        r"(?P<d3>\d{1,2})\s*[-/.]\s*(?P<m3>\d{1,2})\s*[-/.]\s*(?P<y3>\d{4}|\d{2})(?!\d)",
        rf"(?P<d4>\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?[-\s/.,]*(?P<m4>{_MON})\.?[-\s/.,]*(?P<y4>\d{{4}}|\d{{2}})(?!\d)",
        rf"(?P<m5>{_MON})\.?[-\s]+(?P<d5>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y5>\d{{4}})",
    ]
)
_TIME = r"(?:\s*,?\s*(?:at\s+|t)?\s*(?P<H>\d{1,2})[:.](?P<M>\d{2})(?:[:.](?P<S>\d{2})(?:[.,]\d+)?)?\s*(?P<ap>[ap]\.?m\.?)?|t(?P<H2>\d{2})(?P<M2>\d{2})(?P<S2>\d{2}))"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})|\s*(?P<zone>[a-z]+/[a-z_]+(?:/[a-z_]+)?)|\s*(?P<abbr>[a-z]{1,4}))?(?:\s*\([a-z ]+\))?"
_FULL = re.compile(rf"(?:{_DOW})?(?:{_DATE})(?:{_TIME}{_ZONE})?$")
_PART = re.compile(
    rf"(?:(?P<mn>{_MON})\.?(?P<sep>[-\s/,]+)'?(?P<my>\d{{4}}|\d{{2}})|(?P<nm>\d{{1,2}})\s*[-/.]\s*(?P<ny>\d{{4}})|(?P<iy>\d{{4}})\s*[-/.]\s*(?P<im>\d{{1,2}})"
    r"|q\s*(?P<q1>[1-4])[-\s/]*(?P<qy1>\d{4}|\d{2})|(?P<qy2>\d{4})[-\s/]*q\s*(?P<q2>[1-4])|(?P<qw>first|second|third|fourth|1st|2nd|3rd|4th)\s+(?:quarter|qtr)(?:\s+of)?\s+(?P<qy3>\d{4})"
    r"|(?P<y>(?:19|20)\d{2}))$"
)
_SERIAL = re.compile(r"(\d{5})(?:\.\d+)?$")
_EPOCH = re.compile(r"(\d{9,10}|\d{12,13})(?:\.\d+)?$")


def _year(text: str) -> int:
    return int(text) if len(text) == 4 else 2000 + int(text)


def _make(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def local_to_utc(local: datetime, zone: str) -> datetime | None:
    """The instant at which clocks of ``zone`` show ``local``: the earlier of two, None if they skip it."""
    out = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC)
    back = out.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return out if back == local else None


def _parse(text: str, zone: str):
    """(day, None) of a value without time of day, (None, instant) of one with it, or None."""
    s = " ".join(text.replace("\u00a0", " ").split()).lower()
    if not s:
        return None
    if m := _FULL.match(s):
        g = m.groupdict()
        k = next(k for k in "12345" if g["y" + k])
        day = _make(_year(g["y" + k]), _MONTH.get(g["m" + k]) or int(g["m" + k]), int(g["d" + k]))
        if day is None:
            return None
        hour = g["H"] or g["H2"]
        if hour is None:
            return day, None
        hour, minute, second = int(hour), int(g["M"] or g["M2"]), int(g["S"] or g["S2"] or 0)
        if g["ap"]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["ap"][0] == "p")
        if hour > 23 or minute > 59 or second > 59:
            return None
        local = datetime(day.year, day.month, day.day, hour, minute, second)
        if g["off"]:
            o = g["off"].replace(":", "")
            minutes = int(o[1:3]) * 60 + int(o[3:5] or 0)
            return None, (local - timedelta(minutes=-minutes if o[0] == "-" else minutes)).replace(tzinfo=UTC)
        if g["zone"]:
            name = "/".join("_".join(p.capitalize() for p in x.split("_")) for x in g["zone"].split("/"))
            try:
                at = local_to_utc(local, name)
            except (KeyError, ValueError, OSError):
                return None
            return at and (None, at)
        if g["abbr"]:
            if g["abbr"] not in ZONES:
                return None
            return None, (local - timedelta(minutes=ZONES[g["abbr"]])).replace(tzinfo=UTC)
        at = local_to_utc(local, zone)
        return at and (None, at)
    if m := _EPOCH.match(s):
        n = int(m[1])
        return None, datetime.fromtimestamp(n // 1000 if len(m[1]) > 10 else n, UTC)
    return None


def read_day(text: str | None, zone: str = UK) -> tuple[date, str] | None:
    """(day, kind) that a text denotes, kind being ``day``, ``month``, ``quarter`` or ``year``; None for null, blank or unreadable text.

    An instant gives the calendar day of ``zone``; five-digit numbers are sheet serials; months, quarters and years give their first day.
    """
    if text is None:
        return None
    if len(text) == 10 and text.isascii():  # the two most common forms
        if text[4] == text[7] == "-" and text[:4].isdigit() and text[5:7].isdigit() and text[8:].isdigit():
            day = _make(int(text[:4]), int(text[5:7]), int(text[8:]))
            return day and (day, "day")
        if text[2] == text[5] == "/" and text[:2].isdigit() and text[3:5].isdigit() and text[6:].isdigit():
            day = _make(int(text[6:]), int(text[3:5]), int(text[:2]))
            return day and (day, "day")
    if got := _parse(text, zone):
        return got[0] or got[1].astimezone(ZoneInfo(zone)).date(), "day"
    s = " ".join(text.replace("\u00a0", " ").split()).lower()
    if m := _SERIAL.match(s):
        return date(1899, 12, 30) + timedelta(days=int(m[1])), "day"
    m = _PART.match(s)
    if not m:
        return None
    g = m.groupdict()
    if g["mn"]:
        day, kind = _make(_year(g["my"]), _MONTH[g["mn"]], 1), "month"
    elif g["nm"]:
        day, kind = _make(int(g["ny"]), int(g["nm"]), 1), "month"
    elif g["iy"]:
        day, kind = _make(int(g["iy"]), int(g["im"]), 1), "month"
    elif g["y"]:
        day, kind = _make(int(g["y"]), 1, 1), "year"
    else:
        q = int(g["q1"] or g["q2"] or ORDINALS[g["qw"]])
        day, kind = _make(_year(g["qy1"] or g["qy2"] or g["qy3"]), 3 * q - 2, 1), "quarter"
    return day and (day, kind)


def day_of(text: str | None, zone: str = UK) -> str | None:
    """``YYYY-MM-DD`` of the calendar day of ``zone`` that ``text`` denotes, else None (see ``read_day``)."""
    got = read_day(text, zone)
    return got and got[0].isoformat()


def precision_of(text: str | None, zone: str = UK) -> str | None:
    """``day``, ``month``, ``quarter`` or ``year``: what a value that ``day_of`` reads denotes."""
    got = read_day(text, zone)
    return got and got[1]


def instant_of(text: str | None, zone: str = UK) -> str | None:
    """``YYYY-MM-DDTHH:MM:SSZ`` of the instant that ``text`` denotes, ``YYYY-MM-DD`` if it has no time of day, else None."""
    got = text is not None and _parse(text, zone)
    if not got:
        return None
    return got[0].isoformat() if got[0] else got[1].strftime("%Y-%m-%dT%H:%M:%SZ")


def zoneless_local(text: str | None) -> datetime | None:
    """The clock time of a value that has a time of day and no zone; None for any other."""
    if text is None:
        return None
    m = _FULL.match(" ".join(text.replace("\u00a0", " ").split()).lower())
    if not m or not (m["H"] or m["H2"]) or m["off"] or m["zone"] or m["abbr"]:
        return None
    got = _parse(text, "UTC")
    return got[1].replace(tzinfo=None) if got and got[1] else None

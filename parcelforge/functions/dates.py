"""Dates in text as column expressions (one fixed set of forms; ``flexdate`` reads many more)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.flexdate import MONTHS
from parcelforge.functions.text import blank, col, strip

_MONTH_OF = {m[:k]: i + 1 for i, m in enumerate(MONTHS) for k in (3, len(m))}


def _day(y: Column, m: Column, d: Column) -> Column:
    pad = lambda c, n: F.lpad(c, n, "0")
    return F.date_format(F.try_to_date(F.concat_ws("-", pad(y, 4), pad(m, 2), pad(d, 2)), "yyyy-MM-dd"), "yyyy-MM-dd")


def iso_date(c: Column | str) -> Column:
    """ISO form of ISO days, D/M/Y, M/Y, month names with year, quarters and years; anything else as it is; null for blank."""
    s = strip(c)
    g = lambda p, i: F.regexp_extract(s, p, i)
    dmy, my, mon, q = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{1,2})[/-](\d{4})$", r"^([A-Za-z]+)\s+(\d{4})$", r"(?i)^Q([1-4])\s*[/-]?\s*(\d{4})$"
    month_of = F.create_map(*(F.lit(x) for k, v in _MONTH_OF.items() for x in (k, str(v))))
    month = F.try_element_at(month_of, F.lower(g(mon, 1)))
    start = (g(q, 1).try_cast("int") * 3 - 2).cast("string")
    return (
        F.when(blank(c), None)
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
        .when(s.rlike(dmy), F.coalesce(_day(g(dmy, 3), g(dmy, 2), g(dmy, 1)), s))
        .when(s.rlike(my), F.coalesce(_day(g(my, 2), g(my, 1), F.lit("1")), s))
        .when(s.rlike(mon) & month.isNotNull(), _day(g(mon, 2), month, F.lit("1")))
        .when(s.rlike(q), _day(g(q, 2), start, F.lit("1")))
        .when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
        .otherwise(s)
    )


def quarter_text(c: Column | str, checked: bool) -> Column:
    """``YYYY Qn`` of a quarter, D/M/Y or M/Y text; ``checked`` wants months from 1 to 12 and years from 2000 to 2100."""
    s = strip(c)
    g = lambda p, i: F.regexp_extract(s, p, i)
    new, old, dmy, my = r"(?i)^(\d{4})\s*Q([1-4])$", r"(?i)^Q([1-4])\s*[-/]?\s*(\d{4})$", r"^\s*\d*[^/]*/\s*(\d+)\s*/\s*(\d+)\s*$", r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    month = F.when(s.rlike(dmy), g(dmy, 1)).when(s.rlike(my), g(my, 1)).try_cast("int")
    year = F.when(s.rlike(dmy), g(dmy, 2)).when(s.rlike(my), g(my, 2)).try_cast("int")
    ok = F.lit(True) if not checked else month.between(1, 12) & year.between(2000, 2100)
    made = F.concat(year, F.lit(" Q"), (F.floor((month - 1) / 3) + 1))
    return F.when(s.rlike(new), F.concat(g(new, 1), F.lit(" Q"), g(new, 2))).when(s.rlike(old), F.concat(g(old, 2), F.lit(" Q"), g(old, 1))).when(ok, made)


def quarter_ordinal(c: Column | str) -> Column:
    """year * 4 + quarter of ``2025 Q1`` or ``Q1 2025``, whatever follows."""
    s = strip(c)
    new, old = r"(?i)^(\d{4})\s*Q([1-4])", r"(?i)^Q([1-4])\s*(\d{4})"
    g = lambda p, i: F.regexp_extract(s, p, i).try_cast("int")
    return F.when(s.rlike(new), g(new, 1) * 4 + g(new, 2)).when(s.rlike(old), g(old, 2) * 4 + g(old, 1))


def is_quarter(c: Column | str) -> Column:
    return strip(c).rlike(r"(?i)^(\d{4}\s*Q[1-4]|Q[1-4]\s*[-/]?\s*\d{4})$")


def first_of_month(c: Column | str) -> Column:
    """``M/YYYY`` as ``01/MM/YYYY``; anything else stripped."""
    s, p = strip(c), r"^(\d{1,2})/(\d{4})$"
    return F.when(s.rlike(p), F.concat(F.lit("01/"), F.lpad(F.regexp_extract(s, p, 1), 2, "0"), F.lit("/"), F.regexp_extract(s, p, 2))).otherwise(s)


def day_or(c: Column | str, otherwise: Column) -> Column:
    """The day of an ISO or D/M/Y text (a time may follow an ISO day), else ``otherwise``."""
    s = strip(c)
    return F.coalesce(F.try_to_date(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), "d/M/yyyy"), otherwise)


def shown_date(c: Column | str) -> Column:
    """D/M/Y for display; else the first ten letters."""
    s = col(c)
    d = F.coalesce(F.try_to_date(F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), "d/M/yyyy"), F.try_to_date(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.left(s, F.lit(10)))


def quarter_suffix(day: Column) -> Column:
    return F.concat(F.year(day), F.lit(" Q"), F.quarter(day))


def epoch_day(ms: Column | str, raw: Column | str) -> Column:
    """D/M/Y of milliseconds since 1970 in the session's zone, else the raw text."""
    return F.coalesce(F.date_format(F.timestamp_millis(col(ms)), "dd/MM/yyyy"), col(raw))

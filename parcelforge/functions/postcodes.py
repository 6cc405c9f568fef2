"""Postcodes and whole addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import col, strip

# Fixed value: the form of a postcode (no word borders).
POSTCODE = r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}"


def find_postcode(c: Column | str) -> Column:
    """The first postcode in a text as written, '' if none."""
    return F.regexp_extract(col(c), POSTCODE, 0)


def _spaced(s: Column) -> Column:
    return F.when(F.length(s) > 3, F.concat(F.left(s, F.length(s) - 3), F.lit(" "), F.right(s, F.lit(3)))).otherwise(s)


def tidy_postcode(c: Column | str) -> Column:
    """Capitals and one space before the last three letters; texts that do not begin like a postcode only in capitals."""
    s = F.upper(F.regexp_replace(col(c), r"(?U)\s", ""))
    return F.when(s.rlike("^" + POSTCODE[4:]), _spaced(s)).otherwise(F.upper(strip(c)))


def archive_postcode(c: Column | str) -> Column:
    """The first postcode of a text, tidied; '' if none."""
    return _spaced(F.upper(F.regexp_replace(find_postcode(c), r"(?U)\s", "")))


def sheet_postcode(c: Column | str) -> Column:
    """The postcode of the last part between commas, in capitals, spaces as written."""
    return F.upper(find_postcode(F.element_at(F.split(col(c), ","), -1)))


def cut_postcode(address: Column | str) -> Column:
    """The address without its first postcode and the commas around it."""
    a = strip(address)
    at = F.regexp_instr(a, F.lit(POSTCODE))
    head = F.regexp_replace(F.left(a, at - 1), r"[, ]+$", "")
    tail = F.substring(a, at + F.length(find_postcode(a)), F.length(a))
    return F.when(at > 0, strip(F.regexp_replace(strip(F.concat(head, tail)), ",+$", ""))).otherwise(a)


def with_postcode(address: Column | str, code: Column | str) -> Column:
    """The address with the postcode behind it unless it holds it."""
    a, p = F.coalesce(col(address), F.lit("")), F.coalesce(col(code), F.lit(""))
    return F.regexp_replace(F.when((p != "") & ~F.contains(a, p), F.concat(a, F.lit(", "), p)).otherwise(a), r"^[, ]+|[, ]+$", "")


def total_address(address: Column | str, town: Column | str, code: Column | str) -> Column:
    """Address, town and postcode, each of the latter only if the address does not hold it."""
    a, t, p = (F.coalesce(strip(c), F.lit("")) for c in (address, town, code))
    keep = lambda c: F.when((c != "") & ~F.contains(F.lower(a), F.lower(c)), c)
    return F.concat_ws(", ", F.when(a != "", a), keep(t), keep(p))

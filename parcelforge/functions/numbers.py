"""Numbers in text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import col, strip

# Words that stand for no number; square feet of an acre.
NO_NUMBER = ["null", "none", "n/a", "tbc", "poa"]
NO_TEXT = ["null", "none", "n/a"]
SQFT_PER_ACRE = 43_560
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_float(c: Column | str) -> Column:
    """A number from text with pound signs, commas and spaces; null where it is none.  Zero stays zero."""
    s = strip(F.translate(col(c), "£, ", ""))
    return F.when(s.rlike(_FLOAT), s.try_cast("double"))


def to_number(c: Column | str) -> Column:
    """``to_float`` with zero as null."""
    return F.nullif(to_float(c), F.lit(0.0))


def to_int(c: Column | str) -> Column:
    """``to_float`` cut to a whole number."""
    return to_float(c).cast("int")


def clean_text(c: Column | str) -> Column:
    """Stripped text; '' for null and for words that stand for nothing."""
    s = F.coalesce(strip(c), F.lit(""))
    return F.when(F.lower(s).isin(*NO_TEXT), "").otherwise(s)


def acres_to_sqft(c: Column | str) -> Column:
    """Square feet of the first number of acres in a text; a comma is a decimal point."""
    n = F.regexp_extract(col(c), r"(?i)(\d+(?:[.,]\d+)?)\s*(?:-?\s*)?(?:acres?|ac)\b", 1)
    v = F.replace(n, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v > 0, F.round(v * SQFT_PER_ACRE, 0))


def per_area(amount: Column | str, area: Column | str) -> Column:
    """Amount per unit of area, to two places; null where either is missing or zero."""
    return F.round(F.nullif(col(amount), F.lit(0.0)) / F.nullif(col(area), F.lit(0.0)), 2)


def truthy(c: Column | str) -> Column:
    """Neither null nor zero."""
    return F.coalesce(col(c) != 0, F.lit(False))


def close(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """Two numbers above zero that differ by at most ``tolerance`` of their mean."""
    a, b = col(a), col(b)
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) / F.nullif((a + b) / 2, F.lit(0.0)) <= tolerance), F.lit(False))

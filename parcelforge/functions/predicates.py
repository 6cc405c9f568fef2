"""Filters over mails, records and files as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.numbers import close
from parcelforge.functions.text import blank, col, strip, telling_words, words, name_key

# What shows that a note is about an investment, a unit is vacant or still on offer.
VACANT = r"(?i)\bvacant\b"
INVESTMENT = r"(?i)investment\s+comp|\bNIY\b|\byield\b|\bcap\s*val"
INVESTMENT_LOOSE = r"(?i)\b(?:NIY|yield|cap(?:ital)?\s*val(?:ue)?)"
AVAILABLE = r"(?i)\bavailable(?:\s+now)?\b"
IMAGE = r"(?i)\.(jpg|jpeg|png|gif|bmp|webp|tiff|ico)$"
JUNK_IMAGE = r"(?i)^(image\d*|photo\d*|pic\d*|logo|stamp|seal|banner|footer|header|signature|icon|spacer|pixel|tracking|~WRD\d*|Slide\d*)\."
STUB_WORDS = ["comps", "comparables", "comp", "market evidence", "rent review", "dilapidations", "service charge", "schedule of condition"]
DOCUMENTS = r"(?i)\.(pdf|xlsx|xls)$"
ATTACHMENTS = r"(?i)\.(pdf|xlsx|xls|pptx|ppt)$"
# What names of financial models hold.
MODEL_WORDS = ["model", "appraisal", "cashflow", "cash flow", "cash_flow", "underwriting", "proforma", "pro forma", "pro-forma", "forecast", "budget", "valuation", "sensitivity", "irr analysis", "dcf"]
#: Bytes below which an image is a logo.
SMALL_IMAGE = 50 * 1024


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def from_domains(domain: Column | str, allowed: list[str]) -> Column:
    """The domain, or one that it belongs to, is listed; nothing is if the list is empty."""
    d = F.lower(col(domain))
    return F.coalesce(any_of([(d == e) | d.endswith("." + e) for e in (a.lower().lstrip("@") for a in allowed)]), F.lit(False))


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text holds, anywhere and in any case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(k) for k in keywords)).cast("array<string>"), lambda k: F.contains(t, F.lower(k)))


def qualifies(labelled: Column, tests: list[Column], need_all: bool = False) -> Column:
    """A label passes; else all, or any, of the tests that are set; without tests everything passes."""
    if not tests:
        return F.lit(True)
    return labelled | (reduce(lambda a, b: a & b, tests) if need_all else any_of(tests))


def vacant(tenant: Column | str, notes: Column | str) -> Column:
    said = lambda c: F.coalesce(col(c).rlike(VACANT), F.lit(False))
    return said(tenant) | (blank(tenant) & said(notes))


def about_investment(notes: Column | str, loose: bool = False) -> Column:
    return F.coalesce(col(notes).rlike(INVESTMENT_LOOSE if loose else INVESTMENT), F.lit(False))


def available(*cols: str) -> Column:
    return any_of([F.coalesce(col(c).rlike(AVAILABLE), F.lit(False)) for c in cols])


def junk_image(name: Column | str, size: Column | str, inline: Column) -> Column:
    n = col(name)
    return n.rlike(IMAGE) & (inline | ((col(size) > 0) & (col(size) < SMALL_IMAGE)) | n.rlike(JUNK_IMAGE))


def stub_name(name: Column | str) -> Column:
    return any_of([F.contains(F.lower(col(name)), F.lit(w)) for w in STUB_WORDS])


def is_attachment(name: Column | str) -> Column:
    """A mail's file that is kept as a brochure."""
    return col(name).rlike(ATTACHMENTS)


def financial_model(name: Column | str) -> Column:
    """A file's name that shows a model or an appraisal rather than a brochure."""
    return any_of([F.contains(F.lower(col(name)), F.lit(w)) for w in MODEL_WORDS])


def route(deals: Column, introduction: Column, files: Column, name: Column) -> Column:
    """What becomes of a thread: its ``deals``; without any ``not introduction``, a ``stub`` named by the subject, ``not a stub`` where that name shows other things, or an ``error``."""
    nothing = ~F.coalesce(introduction, F.lit(False)) & ~F.coalesce(files, F.lit(False))
    return F.when(F.coalesce(deals, F.lit(0)) > 0, "deals").when(nothing, "not introduction").when(~F.coalesce(files, F.lit(False)), "error").when(stub_name(name), "not a stub").otherwise("stub")


def is_document(name: Column | str) -> Column:
    return col(name).rlike(DOCUMENTS)


def rents_agree(a_pa, a_psf, b_pa, b_psf, tolerance: float) -> Column:
    """Yearly rents are close, or neither is known and rents per area are."""
    return close(a_pa, b_pa, tolerance) | (col(a_pa).isNull() & col(b_pa).isNull() & close(a_psf, b_psf, tolerance))


def towns_agree(a, b) -> Column:
    """Equal, or one is blank or stands for several."""
    x, y = F.lower(F.coalesce(strip(a), F.lit(""))), F.lower(F.coalesce(strip(b), F.lit("")))
    return (x == "") | (y == "") | x.startswith("multi") | y.startswith("multi") | (x == y)


def contained(a: Column | str, b: Column | str) -> Column:
    """One name key, of two words or more, holds the other."""
    x, y = name_key(a), name_key(b)
    shorter = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    return (F.size(F.filter(F.split(shorter, " "), lambda w: w != "")) >= 2) & (F.contains(x, y) | F.contains(y, x))


def words_overlap(a: Column | str, b: Column | str) -> Column:
    """Two telling words or more, and 60 % of the shorter set, are shared."""
    x, y = telling_words(a), telling_words(b)
    n, least = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    return (n >= 2) & (n / F.nullif(least, F.lit(0)) >= 0.6)


def sorted_telling(c: Column | str) -> Column:
    """Telling words in order of the alphabet, else the name key."""
    w = telling_words(c)
    return F.when(F.size(w) > 0, F.array_join(F.array_sort(w), " ")).otherwise(F.array_join(words(c), " "))

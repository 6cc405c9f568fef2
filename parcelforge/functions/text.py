"""Text normalisation as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of property names that do not tell properties apart.
STOP_WORDS = [
    "the", "a", "an", "and", "of", "at", "in", "on", "for", "site", "park", "estate", "industrial", "trading", "business", "investment", "fund", "intro", "introduction", "portfolio",
    "centre", "center", "works", "unit", "units", "road", "street", "lane", "way", "drive", "close", "ltd", "limited", "plc", "son", "sons", "rd", "st", "ave", "ct", "pl", "sq",
    "north", "south", "east", "west",
]
# Legal forms dropped from tenant names; characters that file systems forbid.
LEGAL_FORMS = ["ltd", "limited", "plc", "inc", "llp", "llc"]
FORBIDDEN = r'[<>:"/\\|?*]'
#: Longest folder name, longest file name, and what is kept of a longer file name's stem.
FOLDER_LENGTH, FILE_LENGTH, STEM_LENGTH = 100, 200, 190


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    """Null or nothing but white space."""
    return col(c).isNull() | (strip(c) == "")


def filled(c: Column | str) -> Column:
    """The text, null where it is blank."""
    return F.when(~blank(c), col(c))


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def name_key(c: Column | str) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return squeeze(F.regexp_replace(F.lower(col(c)), r"(?U)[^\w\s]", " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(name_key(c), " "), lambda w: w != "")


def telling_words(c: Column | str) -> Column:
    """Distinct words of two letters or more that are no stop words, in order."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def tenant_key(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(name_key(c), rf"(?U)\b({'|'.join(LEGAL_FORMS)})\b", ""))


def unit_key(c: Column | str) -> Column:
    k = F.regexp_replace(name_key(c), r"(?U)\b0+(\d)", "$1")
    return strip(F.regexp_replace(F.regexp_replace(k, r"(?U)\bunit\b\s*", ""), r"(?U)\bplot\b\s*", ""))


def mail_domain(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"@([\w.-]+)", 1))


def mail_address(c: Column | str) -> Column:
    """The address in angle brackets, else the first bare one, else the text in lower case."""
    a = F.regexp_extract(col(c), r"<([^>]+)>", 1)
    b = F.regexp_extract(col(c), r"([\w.+-]+@[\w.-]+)", 1)
    return F.lower(F.when(a != "", a).when(b != "", b).otherwise(strip(c)))


# Patterns of what subjects carry before and behind a name: reply marks, boilerplate, a postcode's beginning.
SUBJECT_LEAD = r"(?i)^(?:(?:RE|FW|Fwd)\s*:\s*)+"
SUBJECT_TAILS = [r"(?i)\s*-\s*(?:Subject to|Revised|Logistics Warehous|Investment Opport)[^\n]*$", r"\s*-\s+[A-Z]{1,2}\d[^\n]*$"]


def subject_name(c: Column | str) -> Column:
    """A mail subject without reply marks and trailing boilerplate; '' for null."""
    s = strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), SUBJECT_LEAD, ""))
    for tail in SUBJECT_TAILS:
        s = strip(F.regexp_replace(s, tail, ""))
    return s


# What separates a mail from the one it answers, in the order of trust.
REPLY_MARKS = [r"(?imd)^From:\s+[^\n]+?\n\s*Sent:\s+", r"(?imd)^On\s+[^\n]{10,80}\s+wrote:\s*$", r"(?i)-{3,}\s*Original Message\s*-{3,}", r"_{10,}"]


def before_reply(c: Column | str) -> Column:
    """The text before the first reply mark that has text before it; otherwise all of it."""
    c = col(c)
    out = []
    for mark in REPLY_MARKS:
        head = F.regexp_replace(F.split(c, mark, 2)[0], r"(?U)\s+$", "")
        out.append(F.when((F.regexp_instr(c, F.lit(mark)) > 0) & (head != ""), head))
    return F.coalesce(*out, c)


def folder_safe(c: Column | str) -> Column:
    s = F.regexp_replace(squeeze(F.regexp_replace(col(c), FORBIDDEN, "")), r"[. ]+$", "")
    return F.when(F.length(s) > FOLDER_LENGTH, F.regexp_replace(F.left(s, F.lit(FOLDER_LENGTH)), r"(?U)\s+$", "")).otherwise(s)


def file_safe(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(col(c), FORBIDDEN, "_"), r"^[. ]+|[. ]+$", "")
    suffix = F.regexp_extract(s, r"[^.](\.[^.]+)$", 1)
    stem = F.left(s, F.length(s) - F.length(suffix))
    return F.when(F.length(s) > FILE_LENGTH, F.concat(F.left(stem, F.lit(STEM_LENGTH)), suffix)).otherwise(s)


def folder_name(town: Column | str, name: Column | str, agent: Column | str, date: Column | str) -> Column:
    """``Town, Name``, or what there is of it, else a name from agent and date."""
    t, n = F.coalesce(strip(town), F.lit("")), F.coalesce(strip(name), F.lit(""))
    none = lambda c, w: F.coalesce(F.when(col(c) != "", col(c)), F.lit(w))
    other = F.concat(F.lit("Unknown - "), none(agent, "No Agent"), F.lit(" - "), none(date, "No Date"))
    return folder_safe(F.when((t != "") & (n != ""), F.concat_ws(", ", t, n)).when(n != "", n).when(t != "", t).otherwise(other))


def without_quarter(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s*\(\d{4} Q[1-4]\)$", "")


def dated_folder(day: Column, agent: Column | str) -> Column:
    return folder_safe(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" - "), F.coalesce(filled(agent), F.lit("Unknown"))))


def html_text(c: Column | str) -> Column:
    """Plain text of simple HTML: breaks and paragraphs as line feeds, tags and numeric entities dropped, four named entities read."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"(?i)<br\s*/?>", "\n"), r"(?i)<p[^>]*>", "\n\n")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for entity, letter in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(entity), F.lit(letter))
    return strip(F.regexp_replace(F.regexp_replace(s, r"&#\d+;", ""), r"\n{3,}", "\n\n"))


def decode_url64(c: Column | str) -> Column:
    """Text of URL-safe base64; bytes that are no UTF-8 become the replacement character."""
    return F.make_valid_utf8(F.try_to_binary(F.translate(col(c), "-_", "+/"), F.lit("base64")).cast("string"))


def shortened(c: Column | str, most: int, mark: str = "") -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most)), F.lit(mark))).otherwise(col(c))

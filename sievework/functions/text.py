"""Parsing of text cells. All are Column -> Column, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are accepted: no digit groups by `_`, no hexadecimal, no inf or nan.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Formats tried in this order, and what they are called.
DATE_FORMATS = (
    ("yyyy-M-d", "ISO (YYYY-MM-DD)"),
    ("d/M/yyyy", "day-first (DD/MM/YYYY)"),
    ("M/d/yyyy", "month-first (MM/DD/YYYY)"),
    ("d-MMM-yyyy", "abbreviated month (DD-Mon-YYYY)"),
    ("yyyy/M/d", "slashed ISO (YYYY/MM/DD)"),
)
PHONE_FORMATS = (
    (r"^\d{3}-\d{3}-\d{4}$", "NNN-NNN-NNNN (target format)"),
    (r"^\(\d{3}\)\s*\d{3}-\d{4}$", "(NNN) NNN-NNNN"),
    (r"^\d{3}\.\d{3}\.\d{4}$", "NNN.NNN.NNNN"),
    (r"^\+\d{10,15}$", "+E164 style"),
    (r"^\d{10}$", "NNNNNNNNNN (no separators)"),
    (r"^\d{3}-\d{3}-\d{4}\s*(ext|x)\.?\s*\d+$", "with extension"),
)
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
EMAIL_STRICT = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+$"
PHONE_STRICT = r"^\d{3}-\d{3}-\d{4}$"
#: strptime's directives and what date parsing here calls them.
DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%y": "yy"}


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at either end, which trim() would leave."""
    # a run within the text is looked at once, from its first character on
    return F.regexp_replace(text(c), r"(?U)^\s++|(?<!\s)\s++$", "")


def missing(c: Column, tokens) -> Column:
    return strip(c).isin(*tokens)


def number(c: Column) -> Column:
    """Double, or null; signs of currency and thousands are dropped."""
    bare = strip(F.translate(text(c), "$,", ""))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def pattern(date_format: str) -> str:
    for a, b in DIRECTIVES.items():
        date_format = date_format.replace(a, b)
    return date_format


def date(c: Column, date_format: str = "%Y-%m-%d") -> Column:
    return F.try_to_date(text(c), pattern(date_format))


def any_date(c: Column) -> Column:
    """The first of DATE_FORMATS that parses."""
    return F.coalesce(*(F.try_to_date(strip(c), p) for p, _ in DATE_FORMATS))


def date_label(c: Column) -> Column:
    return F.coalesce(*(F.when(F.try_to_date(strip(c), p).isNotNull(), F.lit(label)) for p, label in DATE_FORMATS))


def phone_label(c: Column) -> Column:
    s = strip(c)
    return F.coalesce(*(F.when(s.rlike(p), F.lit(label)) for p, label in PHONE_FORMATS))


def shape(c: Column, cap: int = 24) -> Column:
    """Letters as x, digits as 9: a value's form without the value."""
    return F.regexp_replace(F.regexp_replace(F.substring(text(c), 1, cap), "[A-Za-z]", "x"), r"(?U)\d", "9")


def is_alphabetic(c: Column) -> Column:
    return F.translate(text(c), " -", "").rlike(r"^\p{L}+$")


def age(d: Column, as_of) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), d) / F.lit(365.25)


def birth_year(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text(c), r"(\d{4})", 1), F.lit("")), F.lit("?"))


def locality(c: Column) -> Column:
    """What follows the last comma, in lower case."""
    return F.lower(strip(F.substring_index(text(c), ",", -1)))

"""Normalisers: a cell's standard form, or null where it can't be mended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, strip, text


def phone(c: Column) -> Column:
    d = F.regexp_replace(text(c), r"[^\p{Nd}]", "")
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)))


def email(c: Column) -> Column:
    return F.lower(c)


def _parts(c: Column) -> tuple[Column, Column, Column]:
    slashed = F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), c)
    return slashed, F.regexp_extract(slashed, r"^(\d+)/", 1).try_cast("int"), F.regexp_extract(slashed, r"/(\d+)/", 1).try_cast("int")


def date(c: Column, policy: str = "day_first") -> Column:
    """ISO text. With slashes a part above 12 forces the order; else the policy decides."""
    c = strip(c)
    slashed, a, b = _parts(c)
    day, month = F.try_to_date(slashed, "d/M/yyyy"), F.try_to_date(slashed, "M/d/yyyy")
    d = F.coalesce(*(F.try_to_date(c, p) for p in ("yyyy-M-d", "d-MMM-yyyy", "yyyy/M/d")), F.when(a > 12, day).when(b > 12, month).otherwise(day if policy == "day_first" else month))
    return F.date_format(d, "yyyy-MM-dd")


def ambiguous_date(c: Column, policy: str = "day_first") -> Column:
    """Whether only the policy told day from month."""
    c = strip(c)
    _, a, b = _parts(c)
    return F.coalesce((a <= 12) & (b <= 12) & date(c, policy).isNotNull(), F.lit(False))


def whole(c: Column) -> Column:
    n = number(c)
    return F.when(n == F.floor(n), n.try_cast("decimal(38,0)").cast("string"))


def decimal(c: Column) -> Column:
    """Rounded to two places as decimal text of the nearest double, at least one place shown."""
    return F.regexp_replace(F.replace(F.format_number(number(c), 2), F.lit(","), F.lit("")), r"([.][0-9])0$", "$1")


def name(c: Column) -> Column:
    """Each run of ASCII letters, with one apostrophe in it, with a capital and then small letters."""
    pieces = F.regexp_extract_all(strip(c), F.lit("[A-Za-z]+(?:'[A-Za-z]+)?|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda t: F.when(t.rlike("^[A-Za-z]"), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))).otherwise(t)), "")


def category(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    low = F.lower(strip(c))
    if not synonyms:
        return low
    known = F.create_map(*(F.lit(x) for pair in sorted(synonyms.items()) for x in pair))
    return F.coalesce(F.element_at(known, low), low)

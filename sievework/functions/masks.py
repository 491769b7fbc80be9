"""Masking methods, by name. Each builder gets the column, its rule's parameters and the salt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUMBER, strip, text


def initial_only(c: Column, keep: int = 1, **_) -> Column:
    v = strip(c)
    return F.when(v == "", v).otherwise(F.concat(F.substring(v, 1, keep), F.lit("***")))


def partial_email(c: Column, keep: int = 1, **_) -> Column:
    v = strip(c)
    local, domain = (F.regexp_extract(v, r"(?s)^(.*)@([^@]*)$", i) for i in (1, 2))
    return F.when(F.instr(v, "@") > 0, F.concat(F.substring(local, 1, keep), F.lit("***@"), domain)).otherwise("***")


def partial_tail(c: Column, keep: int = 4, **_) -> Column:
    d = F.regexp_replace(text(c), r"[^\p{Nd}]", "")
    return F.when(d == "", "").otherwise(F.concat(F.lit("***-***-"), F.right(d, F.lit(keep))))


def year_only(c: Column, **_) -> Column:
    y = F.regexp_extract(strip(c), r"^(\d{4})", 1)
    return F.when(y == "", "").otherwise(F.concat(y, F.lit("-**-**")))


def redact(c: Column, label: str = "[REDACTED]", **_) -> Column:
    return F.when(strip(c) == "", "").otherwise(label)


def band(c: Column, width: int = 25000, **_) -> Column:
    v = strip(c)
    lo = F.floor(F.when(v.rlike(NUMBER), v.try_cast("double")) / width) * width
    return F.when(lo.isNull(), "").otherwise(F.concat(F.format_number(lo, 0), F.lit("-"), F.format_number(lo + width, 0)))


def pseudonymize(c: Column, salt: Column | None = None, **_) -> Column:
    """A prefix and 12 hex digits of the salted hash. salt is a column, so that the plan need not hold it as a literal."""
    v = strip(c)
    return F.when(v == "", "").otherwise(F.concat(F.lit("CUST_"), F.substring(F.sha2(F.concat(salt, v), 256), 1, 12)))


def access_control(c: Column, **_) -> Column:
    return redact(c, "[ACCESS CONTROLLED]")


METHODS = {f.__name__: f for f in (initial_only, partial_email, partial_tail, year_only, redact, band, pseudonymize, access_control)}

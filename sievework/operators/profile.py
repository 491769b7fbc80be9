"""Profiling: every metric of a column from its distinct values and their counts.

Cells are unpivoted to (column, value) and counted once; all further metrics read this table, in which a value repeated many times is one row.
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import ColumnRule, Contract
from ..functions import text as T
from .validate import ROW_ID, duplicate_rows, value_columns


def frequencies(df: DataFrame, columns: list[str], tokens) -> DataFrame:
    """(column, value, n, first_row, missing) of each distinct cell value."""
    cells = df.select(ROW_ID, *(T.text(F.col(c)).alias(c) for c in columns)).unpivot([ROW_ID], columns, "column", "value")
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first_row"))
    return counted.withColumn("missing", T.missing(F.col("value"), tokens))


def completeness(freq: DataFrame) -> DataFrame:
    """column, total, missing, present, missing_pct."""
    out = freq.groupBy("column").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing"))
    return out.select("column", "total", "missing", (F.col("total") - F.col("missing")).alias("present"), F.round(F.lit(100.0) * F.col("missing") / F.col("total"), 2).alias("missing_pct"))


def distinct_and_lengths(freq: DataFrame) -> DataFrame:
    v, there = F.col("value"), ~F.col("missing")
    out = freq.groupBy("column").agg(
        F.count_if(there).alias("distinct_count"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(there & (v != T.strip(v)), F.col("n"))), F.lit(0)).alias("whitespace_padded"),
        F.coalesce(F.min(F.when(there, F.length(v))), F.lit(0)).alias("min_length"), F.coalesce(F.max(F.when(there, F.length(v))), F.lit(0)).alias("max_length"))
    return out.withColumn("distinct_pct", F.when(F.col("present") > 0, F.round(F.lit(100.0) * F.col("distinct_count") / F.col("present"), 2)).otherwise(0.0))


def _present(freq: DataFrame, rule: ColumnRule) -> DataFrame:
    return freq.where((F.col("column") == rule.name) & ~F.col("missing"))


def _weight(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))


def numeric(freq: DataFrame, rule: ColumnRule) -> DataFrame:
    n = T.number(F.col("value"))
    limits = [_weight(n < rule.min if rule.min is not None else F.lit(False)).alias("below_min"), _weight(n > rule.max if rule.max is not None else F.lit(False)).alias("above_max")]
    mean = F.round(F.sum(n * F.col("n")) / F.sum(F.when(n.isNotNull(), F.col("n"))), 2)
    return _present(freq, rule).agg(_weight(n.isNull()).alias("non_numeric"), F.min(n).alias("min_value"), F.max(n).alias("max_value"), mean.alias("mean_value"), *limits)


def labels(freq: DataFrame, rule: ColumnRule, label: Column) -> DataFrame:
    """(label, n), most frequent first, then by first row; null stands for what no format fits."""
    return _present(freq, rule).groupBy(label.alias("label")).agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row")).orderBy(F.desc("n"), "first_row")


def dates(freq: DataFrame, rule: ColumnRule, as_of: Date) -> DataFrame:
    d = T.any_date(F.col("value"))
    return _present(freq, rule).agg(_weight(d.isNull()).alias("unparseable"), F.min(d).cast("string").alias("min_value"), F.max(d).cast("string").alias("max_value"), _weight(d > F.lit(as_of)).alias("future"))


def categories(freq: DataFrame, rule: ColumnRule) -> DataFrame:
    """(value, n, kind): allowed, case_only or unknown."""
    v = F.col("value")
    kind = F.when(v.isin(*rule.allowed), "allowed").when(F.lower(T.strip(v)).isin(*rule.allowed), "case_only").otherwise("unknown") if rule.allowed else F.lit("unknown")
    return _present(freq, rule).select("value", "n", kind.alias("kind"), "first_row").orderBy(F.desc("n"), "first_row")


def strings(freq: DataFrame, rule: ColumnRule) -> DataFrame:
    v = T.strip(F.col("value"))
    never = F.lit(False)
    return _present(freq, rule).agg(
        _weight(~v.rlike(T.EMAIL) if rule.format == "email" else never).alias("invalid_email"), _weight(~T.is_alphabetic(F.col("value")) if rule.alphabetic else never).alias("non_alphabetic"),
        _weight(F.length(v) < rule.min_length if rule.min_length is not None else never).alias("too_short"), _weight(F.length(v) > rule.max_length if rule.max_length is not None else never).alias("too_long"))


def examples(freq: DataFrame, rule: ColumnRule, when: Column, n: int = 3) -> list[str]:
    return [r.value for r in _present(freq, rule).where(when).orderBy("first_row").select("value").limit(n).collect()]


def cross_columns(df: DataFrame, contract: Contract, as_of: Date) -> DataFrame:
    """One row of checks that take two columns; dates by any format."""
    def when_there(c: str) -> Column:
        return F.when(~T.missing(F.col(c), contract.null_tokens), T.any_date(F.col(c)))

    years = T.age(F.col("born"), as_of)
    status, email, phone = contract.contact
    cut_off = (F.lower(T.strip(F.col(status))) == "active") & T.missing(F.col(email), contract.null_tokens) & T.missing(F.col(phone), contract.null_tokens)
    return df.select(when_there(contract.birth).alias("born"), when_there(contract.created).alias("made"), cut_off.alias("cut_off")).agg(
        F.count_if(F.col("born") > F.col("made")).alias("born_after_created"), F.count_if(years > 120).alias("age_over_120"), F.count_if(years < 18).alias("age_under_18"),
        F.round(F.min(years), 1).alias("age_min"), F.round(F.max(years), 1).alias("age_max"), F.count_if("cut_off").alias("active_but_unreachable"))


def duplicate_people(df: DataFrame, contract: Contract, strict: bool = False) -> DataFrame:
    """One row: n, rows that repeat a person's name and birth; strict: of those, only where keys differ and no part is blank."""
    a, b, c = contract.person
    who = [F.lower(T.strip(F.col(a))).alias("a"), F.lower(T.strip(F.col(b))).alias("b"), T.strip(F.col(c)).alias("c")]
    rows = df.select(*who, T.strip(F.col(contract.key)).alias("key"))
    if strict:
        rows = rows.where("a <> '' and b <> '' and c <> ''")
        return rows.groupBy("a", "b", "c").agg(F.count_distinct("key").alias("k")).where("k > 1").agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    return rows.groupBy("a", "b", "c").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))


def profile(df: DataFrame, contract: Contract, as_of: Date) -> dict:
    """Facts a column and for the table, as a dict. The table of distinct values is kept while it is read."""
    columns = [r.name for r in contract.columns if r.name in df.columns]
    freq = frequencies(df, columns, contract.null_tokens).persist()
    try:
        base = {r.column: r.asDict() for r in completeness(freq).join(distinct_and_lengths(freq).drop("present"), "column").collect()}
        out = {}
        for rule in contract.columns:
            if rule.name not in columns:
                continue
            facts = base.get(rule.name, {"total": 0, "missing": 0, "present": 0, "missing_pct": 0.0, "distinct_count": 0, "distinct_pct": 0.0}) | {"declared_type": rule.type, "pii_class": rule.pii, "issues": []}
            issues = facts["issues"]
            if rule.unique:
                facts["duplicate_values"] = facts["present"] - facts["distinct_count"]
                if facts["duplicate_values"]:
                    facts["duplicate_examples"] = examples(freq, rule, F.col("n") > 1, 5)
                    issues.append(f"{facts['duplicate_values']} duplicate values in a unique column")
            if rule.required and facts["missing"]:
                issues.append(f"{facts['missing']} missing values in a required column")
            if rule.type in ("integer", "numeric"):
                facts |= numeric(freq, rule).first().asDict()
                facts["non_numeric_examples"] = examples(freq, rule, T.number(F.col("value")).isNull()) if facts["non_numeric"] else []
                issues += [f"{facts[k]} values {what}" for k, what in (("below_min", "below minimum"), ("above_max", "above maximum"), ("non_numeric", "are not numbers")) if facts[k]]
            elif rule.type == "date":
                facts |= dates(freq, rule, as_of).first().asDict()
                facts["formats"] = [(r.label, r.n) for r in labels(freq, rule, T.date_label(F.col("value"))).collect() if r.label]
                facts["unparseable_examples"] = examples(freq, rule, T.any_date(F.col("value")).isNull()) if facts["unparseable"] else []
                issues += [f"{facts['future']} dates in the future"] * bool(facts["future"]) + [f"{len(facts['formats'])} date formats in one column"] * (len(facts["formats"]) > 1) + [f"{facts['unparseable']} values are not dates"] * bool(facts["unparseable"])
            elif rule.type == "category":
                # the values themselves are few by nature of a category; the report shows the most frequent
                kinds = {r.kind: r.n for r in categories(freq, rule).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
                facts["value_counts"] = [(r.value, r.n) for r in categories(freq, rule).limit(100).collect()]
                issues += [f"{kinds[k]} values {what}" for k, what in (("case_only", "differ by case only"), ("unknown", "are no category")) if k in kinds]
            else:
                facts |= strings(freq, rule).first().asDict()
                if rule.format == "phone":
                    found = [(r.label, r.n) for r in labels(freq, rule, T.phone_label(F.col("value"))).collect()]
                    facts["formats"], facts["unmatched"] = [x for x in found if x[0]], sum(n for label, n in found if not label)
                    issues += [f"{len(facts['formats'])} phone formats in one column"] * (len(facts["formats"]) > 1) + [f"{facts['unmatched']} values fit no phone format"] * bool(facts["unmatched"])
                issues += [f"{facts[k]} values {what}" for k, what in (("invalid_email", "are not email addresses"), ("non_alphabetic", "are not alphabetic"), ("too_short", "too short"), ("too_long", "too long")) if facts[k]]
            out[rule.name] = facts
    finally:
        freq.unpersist()
    rows = next(iter(out.values()))["total"] if out else df.count()
    cells = rows * len(value_columns(df))
    gone = sum(f["missing"] for f in out.values())
    cross = {}
    if {contract.birth, contract.created, *contract.contact} <= set(df.columns):
        cross = cross_columns(df, contract, as_of).first().asDict()
    if contract.key and set(contract.person) <= set(df.columns):
        cross["same_person"] = duplicate_people(df, contract).first().n
    return {"rows": rows, "columns": out, "duplicate_rows": duplicate_rows(df).first().n, "cells": cells, "missing_cells": gone, "completeness_pct": round(100 * (1 - gone / cells), 2) if cells else 100.0, "cross": cross}

"""Validation: each row's broken rules as an array of structs, exploded on demand; dataset checks; severities; the circuit breaker.

Rules of a row are expressions over that row, so they add no shuffle. Only uniqueness and duplicate rows shuffle, on partial counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import POST, ColumnRule, Contract
from ..functions import text as T

FAILURE = "array<struct<check:string,column:string,severity:string,message:string,value_shape:string>>"
ROW_ID = "_row_id"


def value_columns(df: DataFrame) -> list[str]:
    """What a row says, without what this library adds to it."""
    return [c for c in df.columns if not c.startswith("_")]


def _rules(contract: Contract, rule: ColumnRule, columns: list[str], stage: str, as_of: Date) -> list[Column]:
    v = F.col(f"__v_{rule.name}")
    gone = F.col(f"__gone_{rule.name}")

    def broken(when: Column, check: str, message, shape: bool = False, severity: str | None = None) -> Column:
        return F.when(when, F.struct(
            F.lit(check).alias("check"), F.lit(rule.name).alias("column"), F.lit(severity or contract.severity_of(check, stage, rule.name)).alias("severity"),
            (message if isinstance(message, Column) else F.lit(message)).alias("message"), (T.shape(v) if shape else F.lit(None).cast("string")).alias("value_shape")))

    out: list[Column] = []
    if rule.required:
        flag = f"{rule.name}_missing"
        known = gone & F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag in columns else F.lit(False)
        out.append(broken(known, "required_missing_recorded", f"missing, as {flag} records", severity=contract.severity.get("required_missing_recorded", "warn")))
        out.append(broken(gone & ~known, "required_missing", "required value is missing and not recorded"))
    there = ~gone
    if rule.type in ("integer", "numeric"):
        n = F.col(f"__p_{rule.name}")
        out.append(broken(there & n.isNull(), "type_invalid", f"not a valid {rule.type}", True))
        if rule.type == "integer":
            out.append(broken(there & (n != F.floor(n)), "type_invalid", "not a whole number", True))
        if rule.min is not None:
            out.append(broken(there & (n < rule.min), "range_invalid", f"below minimum {rule.min}"))
        if rule.max is not None:
            out.append(broken(there & (n > rule.max), "range_invalid", f"above maximum {rule.max:,}"))
    elif rule.type == "date":
        d = F.col(f"__p_{rule.name}")
        years = T.age(d, as_of)
        out.append(broken(there & d.isNull(), "type_invalid", f"not a date in {rule.date_format}", True))
        out.append(broken(there & (d > F.lit(as_of)), "range_invalid", "date is in the future"))
        if rule.max_age_years is not None:
            out.append(broken(there & (years > rule.max_age_years), "range_invalid", F.format_string(f"implied age %.0f exceeds {rule.max_age_years}", years)))
            if rule.min_age_years is not None:
                out.append(broken(there & (years < rule.min_age_years), "range_invalid", F.format_string(f"implied age %.0f is under {rule.min_age_years}: compliance review", years)))
    elif rule.type == "category":
        near = F.when(F.lower(v).isin(*rule.allowed), " (but for case)").otherwise("") if rule.allowed else F.lit("")
        out.append(broken(there & ~(v.isin(*rule.allowed) if rule.allowed else F.lit(False)), "category_invalid", F.concat(F.lit("not an allowed category"), near), True))
    else:
        if rule.format == "email":
            out.append(broken(there & ~v.rlike(T.EMAIL_STRICT), "format_invalid", "not a valid email address", True))
        if rule.format == "phone":
            out.append(broken(there & ~v.rlike(T.PHONE_STRICT), "format_invalid", "not in NNN-NNN-NNNN form", True))
        if rule.min_length is not None:
            out.append(broken(there & (F.length(v) < rule.min_length), "length_invalid", F.concat(F.lit("length "), F.length(v).cast("string"), F.lit(f" is below {rule.min_length}"))))
        if rule.max_length is not None:
            out.append(broken(there & (F.length(v) > rule.max_length), "length_invalid", F.concat(F.lit("length "), F.length(v).cast("string"), F.lit(f" exceeds {rule.max_length}"))))
        if rule.alphabetic:
            out.append(broken(there & ~T.is_alphabetic(v), "alphabetic_invalid", "not alphabetic", True))
    return out


def with_failures(df: DataFrame, contract: Contract, stage: str, as_of: Date) -> DataFrame:
    """df and _failures, the array of each row's broken rules. Cells are stripped and parsed once, before the rules read them."""
    rules = [r for r in contract.columns if r.name in df.columns]
    stripped = df.withColumns({f"__v_{r.name}": T.strip(F.col(r.name)) for r in rules})
    parsed = stripped.withColumns(
        {f"__gone_{r.name}": F.col(f"__v_{r.name}").isin(*contract.null_tokens) for r in rules}
        | {f"__p_{r.name}": T.number(F.col(f"__v_{r.name}")) for r in rules if r.type in ("integer", "numeric")}
        | {f"__p_{r.name}": T.date(F.col(f"__v_{r.name}"), r.date_format) for r in rules if r.type == "date"})
    found = [x for r in contract.columns if r.name in df.columns for x in _rules(contract, r, df.columns, stage, as_of)]
    if {contract.birth, contract.created} <= set(df.columns):
        born, made = (T.date(T.strip(F.col(c))) if not contract.rule(c) or contract.rule(c).type != "date" or contract.rule(c).date_format != "%Y-%m-%d" else F.col(f"__p_{c}") for c in (contract.birth, contract.created))
        found.append(F.when(born > made, F.struct(
            F.lit("cross_field_invalid").alias("check"), F.lit(contract.birth).alias("column"), F.lit(contract.severity_of("cross_field_invalid", stage)).alias("severity"),
            F.lit(f"{contract.birth} is after {contract.created}").alias("message"), F.lit(None).cast("string").alias("value_shape"))))
    array = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array()
    return parsed.select(*df.columns, array.cast(FAILURE).alias("_failures"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("f.check", "f.column", "f.severity", "f.message", F.col(ROW_ID).cast("long").alias("row_index"), "f.value_shape")


def row_failures(df: DataFrame, contract: Contract, stage: str, as_of: Date) -> DataFrame:
    """One row a failure of a row: check, column, severity, message, row_index, value_shape."""
    # a plain explode has Catalyst infer a filter on the array and push it down with all rules written out again
    return _flat(with_failures(df, contract, stage, as_of).select(ROW_ID, F.explode_outer("_failures").alias("f")).where("f is not null"))


def failures(df: DataFrame, contract: Contract, stage: str, as_of: Date) -> DataFrame:
    """Failures of rows, and of the dataset, which have no row_index."""
    rows = _flat(with_failures(df, contract, stage, as_of).select(ROW_ID, F.explode("_failures").alias("f")))
    return rows.unionByName(dataset_failures(df, contract, stage))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n, how many rows repeat an earlier one."""
    return df.groupBy(*value_columns(df)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def duplicate_keys(df: DataFrame, column: str, tokens) -> DataFrame:
    """One row: rows and keys of present values that stand more than once."""
    v = T.strip(F.col(column))
    twice = df.where(~v.isin(*tokens)).groupBy(v.alias("v")).count().where("count > 1")
    return twice.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("keys"))


def dataset_failures(df: DataFrame, contract: Contract, stage: str) -> DataFrame:
    def one(rows: DataFrame, check: str, column: str | None, message: Column) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"), F.lit(contract.severity_of(check, stage, column)).alias("severity"),
                           message.alias("message"), F.lit(None).cast("long").alias("row_index"), F.lit(None).cast("string").alias("value_shape"))

    out = one(duplicate_rows(df).where("n > 0"), "duplicate_row", None, F.concat(F.col("n").cast("string"), F.lit(" rows repeat an earlier one")))
    for r in contract.columns:
        if r.unique and r.name in df.columns:
            keys = duplicate_keys(df, r.name, contract.null_tokens).where("keys > 0")
            out = out.unionByName(one(keys, "duplicate_key", r.name, F.concat(F.col("rows").cast("string"), F.lit(" rows share "), F.col("keys").cast("string"), F.lit(" repeated values"))))
    return out


def structural(df: DataFrame, contract: Contract, stage: str) -> list[tuple[str, str | None, str, str]]:
    """(check, column, severity, message) of an empty dataset, or of absent columns; the latter without a job."""
    if df.isEmpty():
        return [("empty_dataset", None, contract.severity_of("empty_dataset", stage), "no rows")]
    absent = [c for c in contract.expected if c not in df.columns]
    return [("missing_column", c, contract.severity_of("missing_column", stage, c), f"column {c} is absent") for c in absent]


@dataclass
class Validation:
    """What a stage's validation found: counts on the driver, failures as a DataFrame."""

    stage: str
    rows: int
    failures: DataFrame | None
    by_check: dict[str, int]
    by_column: dict[str, int]
    quarantined: int
    fatal: str | None = None

    @property
    def total(self) -> int:
        return sum(self.by_check.values())


def validate(df: DataFrame, contract: Contract, stage: str, as_of: Date) -> Validation:
    """All checks of a stage. Fatal structure ends it; past cleaning so does a share of quarantined rows above the contract's."""
    bad = structural(df, contract, stage)
    fatal = next((m for *_, s, m in bad if s == "fail"), None)
    if fatal or bad and bad[0][0] == "empty_dataset":
        counts: dict[str, int] = {}
        for check, *_ in bad:
            counts[check] = counts.get(check, 0) + 1
        return Validation(stage, 0 if bad[0][0] == "empty_dataset" else df.count(), None, counts, {c or "<dataset>": 1 for _, c, *_ in bad}, 0, fatal)
    found = failures(df, contract, stage, as_of)
    counted = found.groupBy("check", "column", "severity").agg(F.count("*").alias("n"), F.first("message").alias("message")).collect()
    by_check: dict[str, int] = {}
    by_column: dict[str, int] = {}
    for check, column, _, _ in bad:
        by_check[check] = by_check.get(check, 0) + 1
        by_column[column] = by_column.get(column, 0) + 1
    for r in counted:
        by_check[r.check] = by_check.get(r.check, 0) + r.n
        by_column[r.column or "<dataset>"] = by_column.get(r.column or "<dataset>", 0) + r.n
    fatal = next((r.message for r in counted if r.severity == "fail"), None)
    rate = quarantine_rate(df, contract, stage, as_of).first()
    if not fatal and stage == POST and rate.rate_pct > contract.max_quarantine_pct:
        fatal = f"{rate.rate_pct:.1f}% of rows would be quarantined, above {contract.max_quarantine_pct:g}%: the source is likely at fault"
    return Validation(stage, rate.rows, found, by_check, by_column, rate.quarantined, fatal)


def quarantine_rate(df: DataFrame, contract: Contract, stage: str, as_of: Date) -> DataFrame:
    """One row: rows, quarantined (rows with a failure of that severity), rate_pct."""
    held = F.exists("_failures", lambda f: f["severity"] == "quarantine")
    out = with_failures(df, contract, stage, as_of).agg(F.count("*").alias("rows"), F.count_if(held).alias("quarantined"))
    return out.withColumn("rate_pct", F.lit(100.0) * F.col("quarantined") / F.greatest("rows", F.lit(1)))

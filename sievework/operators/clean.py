"""Cleaning with an audit trail: one projection, then removal of repeated rows and quarantine of conflicting keys.

Every change is a struct in the row's _changes array, so the trail is complete without being collected. Repeated rows are
removed by an aggregation on all columns that keeps the least row id: partial sums bound what a row repeated many times sends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import ColumnRule, Contract
from ..functions import normalise as N
from ..functions import text as T
from .validate import ROW_ID, value_columns

PLACEHOLDER = "UNKNOWN"
CHANGE = "struct<column:string,action:string,reason:string,before_shape:string,after_shape:string>"


def normaliser(rule: ColumnRule, contract: Contract):
    """The Column -> Column that fits a rule, or None where values stay as they are."""
    if rule.format == "phone":
        return N.phone
    if rule.format == "email":
        return N.email
    if rule.type == "date":
        return lambda c: N.date(c, contract.date_policy)
    if rule.type == "integer":
        return N.whole
    if rule.type == "numeric":
        return N.decimal
    if rule.type == "category":
        return lambda c: N.category(c, contract.synonyms.get(rule.name))
    return N.name if rule.alphabetic else None


def _change(when: Column, column: str, action: str, reason, before: Column | None = None, after: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(action).alias("action"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
                                 (none if before is None else before).alias("before_shape"), (none if after is None else after).alias("after_shape")))


def standardise(df: DataFrame, contract: Contract) -> DataFrame:
    """Steps that need one row only: null tokens, white space, normal forms, missing values. Adds flags, _changes, _drop and _ambiguous."""
    given = value_columns(df)
    tokens = [t for t in contract.null_tokens if t.strip()]
    bare, changes = {}, []
    for c in given:
        s = T.strip(F.col(c))
        token = s.isin(*tokens) if tokens else F.lit(False)
        bare[f"__v_{c}"] = F.when(token, "").otherwise(s)
        changes.append(_change(token, c, "normalised", F.concat(F.lit("null token '"), s, F.lit("' emptied"))))
        changes.append(_change(~token & (T.text(F.col(c)) != s), c, "normalised", "white space around it removed"))
    rest = [c for c in df.columns if c not in given]
    step = df.select(*rest, *(e.alias(n) for n, e in bare.items()), F.array(*changes).alias("__first"))
    forms, ambiguous = {}, F.lit(0)
    for rule in contract.columns:
        v, fn = F.col(f"__v_{rule.name}"), normaliser(rule, contract)
        if rule.name in given and fn:
            forms[f"__n_{rule.name}"] = F.when(v == "", "").otherwise(fn(v))
            if rule.type == "date" and rule.format not in ("phone", "email"):
                ambiguous = ambiguous + N.ambiguous_date(v, contract.date_policy).cast("int")
    step = step.select("*", *(e.alias(n) for n, e in forms.items()), ambiguous.alias("_ambiguous"))
    out, second, flags, drop = {}, [], {}, F.lit(False)
    for c in given:
        rule, v, n = contract.rule(c), F.col(f"__v_{c}"), F.col(f"__n_{c}") if f"__n_{c}" in forms else F.col(f"__v_{c}")
        value = F.coalesce(n, F.lit(""))
        if f"__n_{c}" in forms:
            second.append(_change(n.isNull(), c, "flagged", "can't be normalised; emptied", T.shape(v)))
            second.append(_change(n != v, c, "normalised", f"in {rule.type}/{rule.format or 'standard'} form", T.shape(v), T.shape(n)))
        how, empty = contract.missing.get(c), value == ""
        if how == "drop_row":
            drop = drop | empty
            second.append(_change(empty, c, "dropped", "missing, and the row is of no use without it"))
        elif how == "placeholder":
            second.append(_change(empty, c, "placeholder", f"missing; {PLACEHOLDER} stands for it"))
            value = F.when(empty, PLACEHOLDER).otherwise(value)
        elif how == "flag":
            second.append(_change(empty, c, "flagged", f"missing, as {c}_missing records"))
            flags[f"{c}_missing"] = empty
        out[c] = value
    order = [f"{c}_missing" for c in contract.missing if f"{c}_missing" in flags]
    every = F.filter(F.concat(F.col("__first"), F.array(*second)) if second else F.col("__first"), lambda x: x.isNotNull()).cast(f"array<{CHANGE}>")
    return step.select(*rest, *(e.alias(n) for n, e in out.items()), *(flags[n].alias(n) for n in order), every.alias("_changes"), drop.alias("_drop"), "_ambiguous")


def first_of_repeated(df: DataFrame) -> DataFrame:
    """Rows that no row of a smaller _row_id equals in all value columns."""
    values = value_columns(df)
    own = [c for c in df.columns if c not in values and c != ROW_ID]
    kept = df.groupBy(*values).agg(F.min_by(F.struct(*own), ROW_ID).alias("__own"), F.min(ROW_ID).alias(ROW_ID)) if own else df.groupBy(*values).agg(F.min(ROW_ID).alias(ROW_ID))
    return kept.select(*(F.col(c) if c not in own else F.col(f"__own.{c}") for c in df.columns))


def split_conflicts(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is theirs alone, and rows that share it."""
    shared = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("__key"))
    same = F.col(key) == F.col("__key")
    return df.join(shared, same, "left_anti"), df.join(shared, same, "left_semi")


@dataclass
class Cleaned:
    rows: DataFrame  # value columns, flags, _row_id
    quarantined: DataFrame
    changes: DataFrame  # row_index, column, action, reason, before_shape, after_shape
    standard: DataFrame
    first: DataFrame

    def release(self) -> None:
        self.first.unpersist()
        self.standard.unpersist()

    def summary(self) -> dict[str, int]:
        r = self.standard.agg(F.count("*").alias("rows_in"), F.count_if("_drop").alias("dropped"), F.coalesce(F.sum("_ambiguous"), F.lit(0)).alias("ambiguous")).first()
        return {"rows_in": r.rows_in, "dropped_rows": r.dropped, "ambiguous_dates": r.ambiguous, "rows_out": self.rows.count(), "quarantined": self.quarantined.count()}


def clean(df: DataFrame, contract: Contract) -> Cleaned:
    """df needs _row_id, the order of rows. Standard forms and what is left of repeated rows are persisted, for all that is asked
    of a Cleaned reads them; release() ends that."""
    standard = standardise(df, contract).persist(StorageLevel.DISK_ONLY)
    usable = standard.where(~F.col("_drop")).drop("_drop", "_ambiguous")
    first = first_of_repeated(usable).persist(StorageLevel.DISK_ONLY)
    alone, shared = split_conflicts(first, contract.key) if contract.key else (first, first.limit(0))
    trail = standard.select(F.col(ROW_ID).alias("row_index"), F.explode("_changes").alias("c")).select("row_index", "c.*")
    none = F.lit(None).cast("string")
    repeated = usable.select(ROW_ID).join(first.select(ROW_ID), ROW_ID, "left_anti")
    trail = trail.unionByName(repeated.select(F.col(ROW_ID).alias("row_index"), none.alias("column"), F.lit("dropped").alias("action"), F.lit("equal to an earlier row").alias("reason"), none.alias("before_shape"), none.alias("after_shape")))
    trail = trail.unionByName(shared.select(F.col(ROW_ID).alias("row_index"), F.lit(contract.key).cast("string").alias("column"), F.lit("quarantined").alias("action"), F.lit("key shared with different data").alias("reason"), none.alias("before_shape"), none.alias("after_shape")))
    return Cleaned(alone.drop("_changes"), shared.drop("_changes"), trail, standard, first)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.coalesce("column", F.lit("<row>")).alias("column"), "action").agg(F.count("*").alias("n"))

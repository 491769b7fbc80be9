"""Masking of a table by its contract, and how identifiable rows remain."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions import text as T
from ..functions.masks import METHODS

DEV_SALT = "DEV_ONLY_INSECURE_SALT"


class SaltError(Exception):
    """No salt is set, and pseudonyms without one are guessed by trying all keys."""


def salt(contract: Contract, allow_dev_salt: bool = False) -> str:
    found = os.environ.get(contract.salt_env)
    if not found and not allow_dev_salt:
        raise SaltError(f"{contract.salt_env} is not set")
    return found or DEV_SALT


def masked_columns(contract: Contract, columns: list[str], salted: Column) -> dict[str, Column]:
    out = {}
    for c, rule in contract.masking.items():
        if c in columns:
            out[c] = METHODS[rule["method"]](F.col(c), salt=salted, **{k: v for k, v in rule.items() if k != "method"})
    return out


def mask(df: DataFrame, contract: Contract, key: str) -> DataFrame:
    """df masked, without its flags and without columns never exported. The salt comes by a one-row table, so no plan shows it."""
    one = F.broadcast(df.sparkSession.createDataFrame([(key,)], "__salt string"))
    new = masked_columns(contract, df.columns, F.col("__salt"))
    gone = {"__salt", *contract.drop_on_export, *(c for c in df.columns if c.endswith("_missing"))}
    return df.crossJoin(one).withColumns(new).drop(*gone)


def mask_counts(df: DataFrame, contract: Contract, key: str) -> DataFrame:
    """One row: how many values of each masked column change."""
    one = F.broadcast(df.sparkSession.createDataFrame([(key,)], "__salt string"))
    new = masked_columns(contract, df.columns, F.col("__salt"))
    return df.crossJoin(one).agg(*(F.count_if(T.text(F.col(c)) != e).alias(c) for c, e in new.items()))


def mask_samples(df: DataFrame, contract: Contract, key: str, column: str, n: int = 3) -> list[tuple[str, str]]:
    """First n values of a column that aren't blank, and their masks. Holds raw values: restricted."""
    one = F.broadcast(df.sparkSession.createDataFrame([(key,)], "__salt string"))
    new = masked_columns(contract, df.columns, F.col("__salt"))[column]
    rows = df.where(T.strip(F.col(column)) != "").crossJoin(one).select("_row_id", F.col(column).alias("before"), new.alias("after"))
    return [(r.before, r.after) for r in rows.orderBy("_row_id").limit(n).collect()]


def k_anonymity(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, k_min, k_median (upper, over rows), unique_rows, unique_pct. Groups are counted first, then sizes, so the window runs over distinct sizes only."""
    sizes = df.groupBy(*(T.text(F.col(c)).alias(c) for c in columns)).agg(F.count("*").alias("k")).groupBy("k").agg((F.count("*") * F.col("k")).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("k"))
    total = F.sum("rows").over(Window.partitionBy())
    ranked = sizes.select("k", "rows", upto.alias("upto"), total.alias("total"))
    return ranked.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("k").alias("k_min"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("k"))).alias("k_median"),
        F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("rows"))), F.lit(0)).alias("unique_rows"),
    ).withColumn("unique_pct", F.round(F.lit(100.0) * F.col("unique_rows") / F.col("rows"), 1))


def birth_year_and_city(df: DataFrame, birth: str, address: str) -> DataFrame:
    """How many rows are alone in their birth year and city."""
    return k_anonymity(df.select(T.birth_year(F.col(birth)).alias("year"), T.locality(F.col(address)).alias("city")), ["year", "city"])

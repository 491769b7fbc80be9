"""A first look at a table's numbers and dates: summaries, histograms, correlations. Dates count as days since 1970-01-01, what doesn't parse as missing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*((F.unix_date(F.col(c)) if kinds[c] == "date" else F.col(c)).cast("double").alias(c) for c in columns))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return _numbers(df, columns).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))))


def summary(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """A row a column. Quantiles are values that stand there, at most 1 / accuracy of all rows from their rank, so their state is bounded."""
    quantiles = (F.percentile_approx("value", q, accuracy).alias(name) for name, q in QUANTILES.items())
    return _cells(df, columns).groupBy("column").agg(
        F.count("*").alias("total"), F.count("value").alias("present"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev("value"), 4).alias("std"),
        F.min("value").alias("min_value"), *quantiles, F.max("value").alias("max_value"))


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """column, bin (from 0), n: of bins of equal width from a column's least value to its greatest, those that hold one."""
    cells = _cells(df, columns).where("value is not null")
    ends = cells.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # a row a column
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return cells.join(F.broadcast(ends), "column").groupBy("column", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's coefficient of each pair of columns over rows that have both, null where one doesn't vary; all in one aggregate."""
    pairs = list(combinations(columns, 2))
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    one = _numbers(df, columns).agg(*(F.corr(F.when(w, F.col(a)), F.when(w, F.col(b))).alias(f"c{i}") for i, ((a, b), w) in enumerate(zip(pairs, both))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"c{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)))))

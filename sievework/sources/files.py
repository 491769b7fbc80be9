"""CSV in, CSV, text and JSON out, by any file system that Spark knows.

Rows are read as text only. A row with more fields than the header is an input error; a shorter one is padded with "". _row_id numbers the rows from 0 on: of
files by name, in a file by their order.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import InputError
from ..functions import text

OVERFLOW, CORRUPT = "__overflow", "__corrupt"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines see; a folder of this machine only where Spark runs on no other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return found or f"file://{tempfile.mkdtemp(prefix='sievework-')}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", False).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise InputError(f"{path} has no header")
    names = [c if c is not None else "" for c in first[0]]
    if any(not n for n in names) or len(set(names)) < len(names):
        raise InputError(f"{path} has blank or repeated column names")
    return names


def read_csv(spark: SparkSession, path: str, expected: Sequence[str] = (), multiline: bool = True) -> tuple[DataFrame, list[str]]:
    """Rows of a CSV file with _row_id, and warnings. multiline allows line breaks in quoted cells, at the price that a file is one task."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        raise InputError(f"no such file: {path}")
    if fs.getFileStatus(at).isFile() and fs.getFileStatus(at).getLen() == 0:
        raise InputError(f"{path} is empty")
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW, CORRUPT]])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multiline).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("emptyValue", "").option("columnPruning", False).csv(path)
    # Spark packs splits into tasks by size: a row's place in its split is exact, and splits are put in order by name and place
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    splits = rows.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__at").alias("first"), F.count_if(F.col(CORRUPT).isNull() | F.col(OVERFLOW).isNotNull()).alias("long"))
    seen = splits.orderBy("__file", "__block").collect()  # a row a split
    if long := sum(s.long for s in seen):
        raise InputError(f"{path} has {long} rows with more fields than its header")
    if not seen:
        raise InputError(f"{path} has a header but no rows")
    before = [0, *itertools.accumulate(s.n for s in seen)]
    begins = spark.createDataFrame([(s["__file"], s["__block"], b - s["first"]) for s, b in zip(seen, before)], "__file string, __block long, __shift long")
    rows = rows.join(F.broadcast(begins), ["__file", "__block"]).withColumn("_row_id", F.col("__at") + F.col("__shift")).drop("__file", "__block", "__at", "__shift")
    absent = sorted(set(expected) - set(names))
    if absent:
        raise InputError(f"{path} lacks columns {absent}")
    extra = [n for n in names if expected and n not in expected]
    return rows.drop(OVERFLOW, CORRUPT).na.fill("", names), [f"columns that no contract names: {extra}"] * bool(extra)


def coerced(df: DataFrame, contract) -> DataFrame:
    """For exploration: declared numbers and dates as such, what doesn't fit as null."""
    kinds = {r.name: text.number(F.col(r.name)) if r.type in ("integer", "numeric") else text.any_date(F.col(r.name)) for r in contract.columns if r.type in ("integer", "numeric", "date") and r.name in df.columns}
    return df.withColumns(kinds)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """To a file beside, then renamed, so that no reader sees half of it."""
    fs, at = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    if at.getParent() is not None:
        fs.mkdirs(at.getParent())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()
    _replace(fs, beside, at)


def _replace(fs, beside, at) -> None:
    if fs.exists(at):
        fs.delete(at, True)
    if not fs.rename(beside, at):
        raise OSError(f"can't rename {beside} to {at}")


def write_csv(df: DataFrame, path: str, single: bool = False, order: str | None = None) -> None:
    """A folder of CSV parts, or one part on request, staged beside and renamed when it is whole."""
    fs, at = _fs(df.sparkSession, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    rows = df.coalesce(1) if single else df
    rows = rows.sortWithinPartitions(order).drop(order) if order else rows
    # by default Spark's writer strips cells
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(beside)
    _replace(fs, df.sparkSession._jvm.org.apache.hadoop.fs.Path(beside), at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    if fs.exists(at):
        fs.delete(at, True)

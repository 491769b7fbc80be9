"""Table access, shared scratch tables and Arrow plumbing that the corpus operators have in common."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes, that any operator here broadcasts; beyond either the same join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64_000_000
#: Rows of an Arrow batch, at most; texts may be long.
BATCH_ROWS = 64
#: Staged tables that are not deleted yet.
STAGED: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or where that is unset on a single machine a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and each row is computed once whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    STAGED.append(path)
    return out


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any longer."""
    for t in tables:
        delete(t.sparkSession, t.staged_path)
        STAGED.remove(t.staged_path)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete what has been staged since STAGED was `since` long: for callers that have written what they need from it."""
    while len(STAGED) > since:
        delete(spark, STAGED.pop())


def fits(df: DataFrame) -> bool:
    """Whether df has few enough rows and bytes to be broadcast. Looks at no more rows than that."""
    sized = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    width = sum(sized, F.lit(16 * len(df.columns)))
    r = df.select(width.alias("w")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    return r.n <= BROADCAST_ROWS and (r.w or 0) <= BROADCAST_BYTES


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, drop: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key isn't in drop. The ids are broadcast if few enough, else shuffled; rows with a null key stay."""
    drop = drop.select(key).distinct()
    return docs.join(F.broadcast(drop) if fits(drop) else drop, key, "left_anti")


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores behind it where docs has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key of each row, the same whenever it is read: a hash of file and place in it, or for other tables a number in a staged copy."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(key))
    except AnalysisException:
        return stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")


def text_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns kept, and text as UTF-8 bytes, a null as empty; whatever else docs has is not read."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches small enough for a few Python workers beside a JVM; a worker gives memory back when a task ends."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of one key as a table each, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_pylist()
        at = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > at:
                    held.append(b.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, k
        if at < len(keys):
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)

"""A training corpus from raw documents, stage by stage; each stage reads what its predecessor wrote.

Defined results for odd input: an empty table gives no rows. Null and empty texts are kept by the classifier as their score says, are near duplicates of
nothing and hold no leak; the mix takes none of them, as they have no words. Rows without a doc_id and rows that repeat one are rows of their own: equal texts
keep one row, of the least doc_id (null last). Extra columns pass all stages but the last, whatever their names. Without labels nothing is rejected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, jaccard_join, mixture, ordinal_quality, token_output
from sievework.llm.common import STAGED, delete, free_name, load, numbered, shared_dir, stage, sweep, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; it is fitted on the labelled ones among docs."""
    return ordinal_quality.keep_documents(docs, ordinal_quality.train(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id (null last), of each class of word five-grams with a Jaccard similarity of 0.8 or more."""
    key = free_name(docs, "row_key")
    rows = numbered(docs, key)
    classes = stage(jaccard_join.jaccard_classes(rows.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80), "classes")
    others = classes.where("doc_id <> component_id").select("component_id", F.col("doc_id").alias(key))
    members = others.unionByName(others.select("component_id", F.col("component_id").alias(key)).distinct())
    best = members.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("b"))
    return without(rows, stage(without(members, best.select(f"b.{key}"), key), "copies"), key).drop(key)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item aligns with."""
    key = free_name(docs, "row_key")
    rows = numbered(docs, key)
    pairs = decontaminate.contaminated_pairs(rows.select(F.col(key).alias("doc_id"), "text"), load(spark, sf_dir, "benchmark"))
    return without(rows, stage(pairs.select(F.col("doc_id").alias(key)), "leaks"), key).drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated, kept or left out by their source's target; the one at a source's cut is cut to what is left."""
    return mixture.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of ids on disk, and what is read back from them."""
    import public_tokenizers

    return token_output.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", leaks), ("mixing sources", mix_sources), ("token ids", token_ids)]

#: The stages have a fitted model, alignment and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    since = len(STAGED)
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage_of) in enumerate(STAGES):
        out = stage_of(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{k}")
        # what the stage wrote on its way, and what it read, is no longer needed
        sweep(spark, since)
        if k:
            delete(spark, f"{home}/{k - 1}")
    return docs

"""Mixing sources to target weights: hash-random keys, ranges of them within each source, prefix sums, exact cuts.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share `percent` % of all sizes; a target stops at
`most` times its source's size and the excess is shared again by weight until none is above. Each source is taken whole as often as its
target holds its size; the rest is cut from its documents in order of md5(doc_id). The cut is found by prefix sums in three
levels: sums per source and coarse hash range, sums of the finer ranges in the one that holds the cut, then single rows of the one fine range that holds it.
Each level orders at most 4,096 sums or so a source. So no source, however large, is sorted by one task, and what leaves is one row a source.

Defined results: size is the number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null; rows of size 0 take 0; a source of total
size 0 has target 0; rows with equal doc_id, source and size share what the cut leaves them equally, rounded down. Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, stage

WEIGHTS = (5, 2, 1)
#: Rows of a source that a hash range holds, about.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space, by a scan for where they begin."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def targets(totals: DataFrame, percent: int, most: int) -> DataFrame:
    """source, source_size -> target: min(most * size, level * weight), the level found over sources by how early they fill up."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(percent / 100) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.lit(most) * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"))
    # sources fill up in this order: from the first one that stays open, its level holds for all
    last = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"), "level"))).over(Window.partitionBy())
    target = F.coalesce(F.least(last["level"] * F.col("weight"), (F.lit(most) * F.col("source_size")).cast("double")), (F.lit(most) * F.col("source_size")).cast("double"))
    return levels.withColumn("target", target).select("source", "source_size", "weight", "target")


def cuts(docs: DataFrame, percent: int = 150, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows (doc_id, source, size, key), and one row a source: source_size, target, epochs (whole takes), and the cut:
    rows before (cut_key, cut_size) are taken once more, rows at it `partial` words."""
    sizes = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id")).alias("key")), "sizes")
    bits = min(24, max(4, int(sizes.count() // RANGE_ROWS).bit_length()))
    part = F.shiftright(F.conv(F.substring("key", 1, 6), 16, 10).cast("int"), 24 - bits)
    ranged = sizes.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    ranged = stage(ranged, "ranges")
    totals = ranged.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = stage(targets(totals, percent, most), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs).withColumn("left", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    few = fits(plan)

    def holding(sums: DataFrame, by: str, room: str, given: DataFrame, on) -> DataFrame:
        """Of each source's sums, in the order of `by`, the one in which `room` runs out: source, by, and the room that is left in it."""
        upto = sums.alias("r").join(F.broadcast(given.alias("p")) if few else given.alias("p"), on).select("r.*", room).withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(by)))
        return upto.where(f"upto > {room} and upto - words <= {room}").select("source", by, (F.col(room) - F.col("upto") + F.col("words")).alias("room"))

    coarse = ranged.groupBy("source", F.shiftright("part", bits // 2).alias("span")).agg(F.sum("words").alias("words"))
    span = holding(coarse, "span", "left", plan, same)
    at = holding(ranged, "part", "room", span, same & (F.shiftright(F.col("r.part"), bits // 2) == F.col("p.span")))
    small = F.broadcast(at) if few else at
    rows = sizes.alias("r").join(small.alias("p"), same & (part == F.col("p.part"))).select("r.source", "key", "size", "room")
    rows = rows.groupBy("source", "key", "size").agg(F.count("*").alias("rows"), F.first("room").alias("room"))
    upto = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("source").orderBy("key", "size"))
    cut = rows.withColumn("upto", upto).where("upto > room").withColumn("before", F.col("upto") - F.col("size") * F.col("rows")).groupBy("source").agg(F.min(F.struct("key", "size", F.floor((F.col("room") - F.col("before")) / F.col("rows")).alias("partial"))).alias("cut"))
    out = plan.alias("r").join(cut.alias("p"), same, "left").select("r.source", "source_size", "target", "epochs", F.col("cut.key").alias("cut_key"), F.col("cut.size").alias("cut_size"), F.coalesce("cut.partial", F.lit(0)).cast("long").alias("partial"))
    return sizes, stage(out, "cuts")


def extra(size: Column, key: Column) -> Column:
    """Words that a row gives beyond whole epochs."""
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (size < F.col("cut_size")))
    return F.when(F.col("cut_key").isNull(), 0).when(before, size).when((key == F.col("cut_key")) & (size == F.col("cut_size")), F.col("partial")).otherwise(0)


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's cut. One row a source is broadcast if few enough, else shuffled."""
    plan = plan.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(plan) if fits(plan) else plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mix(docs: DataFrame, percent: int = 150, most: int = 2) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    sizes, plan = cuts(docs, percent, most)
    taken = F.col("epochs") * F.col("size") + extra(F.col("size"), F.col("key"))
    return _planned(sizes, plan).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, percent: int = 150, most: int = 2) -> DataFrame:
    """The mix itself in docs' columns: a row as often as it is taken whole; where the cut falls within a text, one row with
    its first words. Texts are not shuffled."""
    _, plan = cuts(docs, percent, most)
    own = "__"  # what names of columns made here begin with, and none of docs'
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    plan = plan.select("source", *(F.col(c).alias(own + c) for c in ("epochs", "cut_key", "cut_size", "partial")))
    few = fits(plan)
    at = plan.withColumnRenamed("source", f"{own}of")
    rows = docs.withColumns({f"{own}size": word_count(F.col("text")), f"{own}key": mix_key(F.col("doc_id"))})
    rows = rows.join(F.broadcast(at) if few else at, F.col("source").eqNullSafe(F.col(f"{own}of")))
    before = (F.col(f"{own}key") < F.col(f"{own}cut_key")) | ((F.col(f"{own}key") == F.col(f"{own}cut_key")) & (F.col(f"{own}size") < F.col(f"{own}cut_size")))
    here = (F.col(f"{own}key") == F.col(f"{own}cut_key")) & (F.col(f"{own}size") == F.col(f"{own}cut_size"))
    rows = rows.withColumn(f"{own}more", F.when(F.col(f"{own}cut_key").isNull(), 0).when(before, F.col(f"{own}size")).when(here, F.col(f"{own}partial")).otherwise(0))
    whole = F.col(f"{own}epochs") + F.when((F.col(f"{own}more") == F.col(f"{own}size")) & (F.col(f"{own}size") > 0), 1).otherwise(0)
    part = F.when((F.col(f"{own}more") > 0) & (F.col(f"{own}more") < F.col(f"{own}size")), F.array(F.col(f"{own}more"))).otherwise(F.array().cast("array<bigint>"))
    each = F.concat(F.array_repeat(F.lit(None).cast("bigint"), whole.cast("int")), part)
    rows = rows.withColumn(f"{own}words", F.explode(each))
    # the end of each word is marked by a NUL; a text that has some already is cut to its words, joined by spaces
    marked = F.regexp_replace("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", "\0")
    marked = F.replace(F.call_function("substring_index", marked, F.lit("\0"), F.col(f"{own}words").cast("int")), F.lit("\0"), F.lit(""))
    joined = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.greatest(F.col(f"{own}words"), F.lit(0)).cast("int")), " ")
    cut = F.when(F.instr("text", "\0") > 0, joined).otherwise(marked)
    text = F.when(F.col(f"{own}words").isNull(), F.col("text")).otherwise(cut)
    out = [text.alias(c) if c == "text" else F.when(F.col(f"{own}words").isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*out)

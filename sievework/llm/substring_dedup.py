"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier are removed; the first copy stays.

1. Texts equal to an earlier document's are told by their hash; they need no more work than the removal of all their bytes.
2. Every window of `length` bytes is assigned to its minimizer, the leftmost least of its k-byte hashes. It depends on the window's content
   alone, so equal windows meet at equal minimizers. Consecutive windows of one minimizer are one row (minimizer hash, hash of the bytes they span, place):
   about three rows per hundred bytes, sent as blocks by hash range. Rows of equal content are settled by hash: the earliest stays, the others are
   repeats; within a task this happens before the shuffle, so a passage in a third of all documents sends a row a task.
3. Minimizers that span different contents (where shared passages begin and end) only route: their bytes meet by hash range, where the windows are put in
   suffix order, the previous and next smaller positions in it give each window's longest previous factor (suffixes.previous_factors), and windows
   whose factor reaches `length` are repeats. A minimizer with more than `HOT` contents is spread: its windows go one by one, by their first and last bytes.
4. Spans of all repeats are merged per document.

Earlier means a smaller doc_id, or an earlier start in the same document. Defined results: null texts are empty; texts shorter than `length` lose nothing;
null doc_ids come last; rows of one doc_id but different text are ordered by the text's hash; identical rows count as
one document and get the same result each. Extra columns are not read. Equality of contents is by 128 bits of hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fits, grouped, map_arrow, partitions, stage, text_rows
from .suffixes import repeated_windows
from .textnum import TABLE, U, mix, runs

K = 40
#: Copies beyond which a text's are found by broadcast; texts that can have more are MANY_TEXTS at the most.
MANY, MANY_TEXTS = 1000, 100_000
#: Rows that a task holds before it passes them on.
HELD = 400_000
#: Windows of a text that are looked at together.
BLOCK = 1 << 22
#: Different contents of a minimizer beyond which its windows meet by content, not by minimizer.
HOT = 4096
#: Bytes at either end of a window that choose its range then.
ENDS = 20
ROW = np.dtype([("hash", "<u8"), ("content", "<u8"), ("uid", "<i8"), ("start", "<u4"), ("windows", "<u2")])


def kmer_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all runs of K = 32 + 8 bytes, by doubling."""
    h, span, kept = TABLE[b], 1, None
    while span < 32:
        h = h[: len(h) - span] * U(0x9E3779B97F4A7C15) + (h[span:] ^ (h[span:] >> U(29)))
        span *= 2
        if span == 8:
            kept = h
    n = len(b) - K + 1
    return mix(h[:n] * U(0xD6E8FEB86659FD93) + kept[32 : 32 + n])


def super_windows(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of minimizer, first window, number of windows) of the runs of windows that have one minimizer."""
    n = len(b) - length + 1
    h = kmer_hashes(b)
    bits = U(int(len(h)).bit_length())
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=U)
    wide, span = length - K + 1, 1
    while 2 * span <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[:n], key[wide - span : wide - span + n])
    at = (key & ((U(1) << bits) - U(1))).astype(np.int64)
    first, count = runs(at)
    # minimizers are small by choice: mixed again, they spread over all ranges
    return mix(h[at[first]] ^ U(0x5851F42D4C957F2D)), first, count


def _keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha, n_bytes, uid) of all rows, uid in order of documents; and the uids of texts that an earlier document has."""
    rows = text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = stage(rows, "keys")
    odd = not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    if odd:
        ranked = rows.select("doc_id", "sha").distinct().sort(F.col("doc_id").asc_nulls_last(), "sha").withColumn("uid", F.monotonically_increasing_id())
        ranked = stage(ranked, "uids")
        same = F.col("r.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("r.sha") == F.col("u.sha"))
        rows = stage(rows.alias("r").join(ranked.alias("u"), same).select("r.doc_id", "r.sha", "n_bytes", "uid"), "keys")
    else:
        rows = rows.withColumn("uid", F.col("doc_id"))
    first = rows.groupBy("sha").agg(F.min("uid").alias("least"), F.count("*").alias("n")).where("n > 1")
    # texts with very many copies are few, so they are broadcast and their rows stay where they are
    many = max(MANY, rows.count() // MANY_TEXTS)
    often = F.broadcast(first.where(F.col("n") > many).drop("n"))
    rest = rows.select("sha", "uid").join(often.select("sha"), "sha", "left_anti").join(first.where(F.col("n") <= many).drop("n"), "sha")
    later = rows.select("sha", "uid").join(often, "sha").unionByName(rest).where("uid <> least").select("uid").distinct()
    return rows, stage(later, "copies"), odd


def removed_spans(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Spans (uid, start, end; may overlap) that repeat earlier bytes, without those of whole copies; keys; copies."""
    if length < K:
        raise ValueError(f"length must be {K} or more")
    keys, copies, odd = _keys(docs)
    text = _with_uid(docs, keys, odd)
    text = text.join(F.broadcast(copies) if fits(copies) else copies, "uid", "left_anti")
    parts = partitions(docs.sparkSession)
    bits = int(min(20, max(8, int(keys.count() // 1000).bit_length())))
    met = stage(_met(text, length, bits, parts), "met")
    settled = met.where("hash is null").select("uid", "start", F.expr(f"start + windows - 1 + {length}").alias("end"))
    open_ = met.where("hash is not null").groupBy("uid").agg(F.collect_list(F.struct("start", "windows", "hash", "hot")).alias("rows"))
    compared = _compared(_only(text, open_.select("uid")), open_, length, bits, parts)
    return settled.unionByName(compared), keys, copies, odd


def _with_uid(docs: DataFrame, keys: DataFrame, odd: bool) -> DataFrame:
    if not odd:
        return text_rows(docs, F.col("doc_id").cast("long").alias("uid"))
    text = text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("sha", F.sha2("text", 256))
    ids = keys.select("doc_id", "sha", "uid").distinct()
    return text.alias("r").join(ids.alias("u"), F.col("r.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("r.sha") == F.col("u.sha"))).select("uid", "text").dropDuplicates(["uid"])


def _only(text: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of text whose uid is among ids: broadcast if few enough, so that the other texts are not shuffled by a later join."""
    return text.join(F.broadcast(ids), "uid", "left_semi") if fits(ids) else text


def _met(text: DataFrame, length: int, bits: int, parts: int) -> DataFrame:
    """(uid, start, windows, hash, hot): with a null hash, windows that repeat earlier ones; with a hash, windows to be compared by bytes."""
    blocks = pa.schema([("range", pa.int64()), ("rows", pa.binary())])
    ranges = 1 << bits

    def flush(held):
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["start"], rows["uid"], rows["content"], rows["hash"]))]
        again = np.zeros(len(rows), bool)
        again[1:] = (rows["hash"][1:] == rows["hash"][:-1]) & (rows["content"][1:] == rows["content"][:-1]) & (rows["windows"][1:] == rows["windows"][:-1])
        key = (rows["hash"] >> U(64 - bits)).astype(np.int64)
        key[again] = ranges + rows["uid"][again] % ranges
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        s, c = runs(key)
        return batch(blocks, key[s], [rows[i : i + n].tobytes() for i, n in zip(s, c)])

    def deal(batches):
        held, size = [], 0
        for b in batches:
            for uid, t in zip(b.column("uid").to_pylist(), b.column("text").to_pylist()):
                whole = np.frombuffer(t, np.uint8)
                for base in range(0, len(t) - length + 1, BLOCK):
                    part = whole[base : base + BLOCK + length - 1]
                    if len(part) < length:
                        continue
                    hash_, first, count = super_windows(part, length)
                    while len(over := np.flatnonzero(count > 60_000)):  # a run as long as this is cut
                        hash_, first, count = np.append(hash_, hash_[over]), np.append(first, first[over] + 60_000), np.append(count, count[over] - 60_000)
                        count[over] = 60_000
                    rows = np.empty(len(first), ROW)
                    rows["hash"], rows["uid"], rows["start"], rows["windows"] = hash_, uid, first + base, count
                    view = memoryview(t)
                    rows["content"] = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip((first + base).tolist(), (first + base + count - 1 + length).tolist())]
                    held.append(rows)
                    size += len(rows)
                if size >= HELD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    out = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("hash", pa.int64()), ("hot", pa.bool_())])

    def meet(batches):
        for t in grouped(batches, "range"):
            rows = np.frombuffer(b"".join(t["rows"].to_pylist()), ROW)
            done = np.ones(len(rows), bool)
            keep, hot = done, np.zeros(len(rows), bool)
            if t["range"][0].as_py() < ranges:
                order = np.argsort(rows["hash"], kind="stable")
                s, c = runs(rows["hash"][order])
                rows = rows[order[np.repeat(c > 1, c)]]
                rows = rows[np.lexsort((rows["start"], rows["uid"], rows["windows"], rows["content"], rows["hash"]))]
                done = np.zeros(len(rows), bool)
                done[1:] = (rows["hash"][1:] == rows["hash"][:-1]) & (rows["content"][1:] == rows["content"][:-1]) & (rows["windows"][1:] == rows["windows"][:-1])
                s, c = runs(rows["hash"])
                kinds = np.add.reduceat(~done, s) if len(s) else np.empty(0, int)
                keep, hot = done | np.repeat(kinds > 1, c), np.repeat(kinds > HOT, c)
            for i in range(0, len(rows), 100_000):
                some = i + np.flatnonzero(keep[i : i + 100_000])
                r = rows[some]
                if len(r):
                    yield batch(out, r["uid"], r["start"].astype(np.int64), r["windows"].astype(np.int64), pa.array(r["hash"].astype(np.int64), mask=done[some]), hot[some])

    dealt = map_arrow(text, deal, "range long, rows binary").repartition(parts, "range").sortWithinPartitions("range")
    return map_arrow(dealt, meet, "uid long, start long, windows long, hash long, hot boolean")


def _compared(text: DataFrame, open_: DataFrame, length: int, bits: int, parts: int) -> DataFrame:
    """Spans of windows that stand earlier among the windows of their minimizer, by their bytes."""
    pieces = pa.schema([("range", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        for b in batches:
            rows = []
            for uid, t, parts in zip(*(b.column(c).to_pylist() for c in ("uid", "text", "rows"))):
                for r in parts:
                    s, n = r["start"], r["windows"]
                    if r["hot"]:
                        for i in range(s, s + n):
                            w = t[i : i + length]
                            rows.append((xxhash.xxh3_64_intdigest(w[:ENDS] + w[-ENDS:], seed=r["hash"] % 2**64) >> (64 - bits), uid, i, w))
                    else:
                        rows.append((r["hash"] % 2**64 >> (64 - bits), uid, s, t[s : s + n - 1 + length]))
                    if len(rows) >= 50_000:
                        yield batch(pieces, *map(list, zip(*rows)))
                        rows = []
            if rows:
                yield batch(pieces, *map(list, zip(*rows)))

    spans = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def compare(batches):
        for t in grouped(batches, "range"):
            texts = t["bytes"].to_pylist()
            size = np.array([len(x) for x in texts])
            base = np.concatenate(([0], np.cumsum(size)[:-1]))
            windows = size - length + 1
            piece = np.repeat(np.arange(len(size)), windows)
            offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
            uid, start = t["uid"].to_numpy(), t["start"].to_numpy()
            again = repeated_windows(np.frombuffer(b"".join(texts), np.uint8), base[piece] + offset, uid[piece], start[piece] + offset, length)
            u, p = uid[piece][again], (start[piece] + offset)[again]
            if len(u):
                order = np.lexsort((p, u))
                u, p = u[order], p[order]
                new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (p[1:] != p[:-1] + 1))))
                last = np.append(new[1:], len(u)) - 1
                yield batch(spans, u[new], p[new], p[last] + length)

    joined = text.join(open_, "uid")
    dealt = map_arrow(joined.select("uid", "text", "rows"), cut, "range long, uid long, start long, bytes binary").repartition(parts, "range").sortWithinPartitions("range")
    return map_arrow(dealt, compare, "uid long, start long, end long")


def merged(starts, ends) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by spans; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, length: int = 100, keep_bytes: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_bytes what is left as well, as `kept`."""
    spans, keys, copies, odd = removed_spans(docs, length)
    per = stage(spans.groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    text = _with_uid(docs, keys, odd)
    touched = _only(text, per.select("uid")).join(per, "uid")
    schema = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_bytes else [])])

    def cut(batches):
        for b in batches:
            rows = []
            for uid, t, s, e in zip(*(b.column(c).to_pylist() for c in ("uid", "text", "starts", "ends"))):
                gone = merged(s, e)
                left, at = [], 0
                for i, j in gone:
                    left.append(t[at:i])
                    at = j
                left = b"".join([*left, t[at:]])
                rows.append((uid, len(t) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *([left] if keep_bytes else [])))
            yield batch(schema, *(map(list, zip(*rows)) if rows else [[] for _ in schema]))

    changed = map_arrow(touched.select("uid", "text", "starts", "ends"), cut, "uid long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
    copied = copies.withColumn("copy", F.lit(True))
    rows = keys.join(changed, "uid", "left").join(copied, "uid", "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= length)
    out = [
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if keep_bytes:
        rows = rows.join(text, "uid", "left")
        out.append(F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept"))
    return rows.select(*out)

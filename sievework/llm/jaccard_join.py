"""N-gram Jaccard join by grouped prefixes, giving each document its class of linked documents.

A document's set holds its distinct word k-grams (64-bit hashes). Two documents link when 100 * |intersection| >= percent * |union|.

1. One scan counts in how many documents each k-gram stands. Counts travel as sorted blocks by hash range, not as rows.
   K-grams in more than `heavy` documents are put last in the order (by hash otherwise). The order decides only cost,
   never results, so it may be cut to a list of bounded size, which is broadcast.
2. A second scan gives each document its set id (hash of the whole set), its group (hash of prefix and size), and a bitmap.
   Documents of one prefix and size are one group; equal sets are one node from here on, however many copies there are.
3. Prefix tokens of groups meet in lists. Each list pairs its members with a few pivots (least by seeded hashes): as many
   pairs as members, so neither a shared passage nor thousands of copies make a square. Size, position and bitmap
   filters, all upper bounds of the overlap, drop pairs that can't link; the rest are expanded to sets and verified on whole sets.
4. Components of these links. Pairs in a list that still lie in different components, and pass the filters, are verified as well,
   so no link between components is lost; pairs within a component can't change the result.

Defined results: null or empty texts, and texts without words, have n_shingles 0 and are alone in their component; with fewer than k
words the whole sequence is one shingle. A component's id is its least doc_id, null if it has none. Repeated rows are documents
of their own with equal sets. Extra columns are not read. Hashes are 64 bits a k-gram, 128 bits a set, 64 bits a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batch, grouped, map_arrow, partitions, stage, text_rows, unstage
from .components import components
from .textnum import U, ceil_div, distinct_sorted, mix, ngram_hashes, runs, word_hashes

#: Tokens that a task holds before it passes them on.
HELD = 2_000_000
SEEDS = (1, 2, 3)
#: Members of a list that are paired in one unit of work.
BLOCK = 1000
BITS = 1024


def shingles(text: bytes, k: int) -> np.ndarray:
    return distinct_sorted(ngram_hashes(word_hashes(text.lower()), k))


def prefix_length(n: int, percent: int) -> int:
    return n - ceil_div(percent * n, 100) + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap: bits that differ between two of them are at most the tokens that only one set has."""
    odd = np.bincount((mix(tokens) % U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def range_bits(docs: DataFrame) -> int:
    """Bits of hash that name a range: a few hundred documents' share of tokens a range at any size."""
    return int(min(20, max(8, int(docs.count() // 1000).bit_length())))


def _cut(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges present in sorted tokens, and where each begins."""
    which = (tokens >> U(64 - bits)).astype(np.int64)
    start, length = runs(which)
    return which[start], np.append(start, start[-1:] + length[-1:])


def heavy_tokens(docs: DataFrame, k: int, heavy: int, most: int) -> np.ndarray:
    """Hash prefixes (sorted, at most `most`) of the k-grams in the most documents, if in more than `heavy`."""
    spark, bits = docs.sparkSession, range_bits(docs)
    low = U(32 - bits)  # a token is named by its first bits + 32 bits
    blocks = pa.schema([("range", pa.int32()), ("ones", pa.binary()), ("many", pa.binary())])

    def flush(held):
        t = np.sort(np.concatenate(held))
        s, c = runs(t)
        t = t[s]
        names = (t >> low).astype(np.uint32)
        which, at = _cut(t, bits)
        ones, many = [], []
        for i, j in zip(at[:-1], at[1:]):
            one = c[i:j] == 1
            ones.append(names[i:j][one].tobytes())
            many.append(np.stack((names[i:j][~one], c[i:j][~one].astype(np.uint32)), 1).tobytes())
        return batch(blocks, which.astype(np.int32), ones, many)

    def count(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                g = shingles(t, k)
                held.append(g)
                size += len(g)
                if size >= HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    out = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def add(batches):
        for t in grouped(batches, "range"):
            r = U(t["range"][0].as_py())
            one = np.frombuffer(b"".join(t["ones"].to_pylist()), np.uint32)
            many = np.frombuffer(b"".join(t["many"].to_pylist()), np.uint32).reshape(-1, 2)
            name = np.concatenate((one, many[:, 0]))
            n = np.concatenate((np.ones(len(one), np.int64), many[:, 1].astype(np.int64)))
            # few are heavy: sum only names that stand more than once
            order = np.argsort(name)
            name, n = name[order], n[order]
            s, _ = runs(name)
            total = np.add.reduceat(n, s) if len(s) else n
            big = total > heavy
            yield batch(out, ((r << U(32)) | name[s][big].astype(U)).astype(np.int64), total[big])

    counted = map_arrow(text_rows(docs), count, "range int, ones binary, many binary")
    found = stage(map_arrow(counted.repartition(partitions(spark), "range").sortWithinPartitions("range"), add, "token long, n long"), "heavy")
    while found.where(F.col("n") > heavy).count() > most:
        heavy *= 2
    got = np.sort(found.where(F.col("n") > heavy).select("token").toArrow()["token"].to_numpy().astype(U))
    unstage(found)
    return got, bits


def ordered_prefix(tokens: np.ndarray, percent: int, heavy: np.ndarray, bits: int) -> np.ndarray:
    n = len(tokens)
    p = prefix_length(n, percent)
    if not len(heavy):
        return tokens[:p], p
    name = tokens >> U(32 - bits)
    at = np.minimum(np.searchsorted(heavy, name), len(heavy) - 1)
    last = heavy[at] == name
    light = tokens[~last]
    return (light[:p], p) if len(light) >= p else (np.concatenate((light, tokens[last]))[:p], len(light))


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def group_id(prefix: np.ndarray, n: int) -> int:
    return xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n) - 2**63


def can_link(n, m, overlap, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85, heavy: int = 32, most_heavy: int = 1_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    heavies, bits = heavy_tokens(docs, k, heavy, most_heavy)
    last = spark.sparkContext.broadcast(heavies)  # at most most_heavy numbers
    text = text_rows(docs)

    known = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("gid", pa.int64()), ("bits", pa.binary())])

    def describe(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                g = shingles(t, k)
                rows.append((len(g), set_id(g), group_id(ordered_prefix(g, percent, last.value, bits)[0], len(g)), bitmap(g)) if len(g) else (0, None, None, None))
            n, sid, gid, sig = zip(*rows) if rows else ((), (), (), ())
            yield batch(known, b.column("doc_id"), list(n), list(sid), list(gid), list(sig))

    described = stage(map_arrow(text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), describe, "doc_id long, n long, sid binary, gid long, bits binary"), "sets")
    sets = stage(described.where("n > 0").groupBy("sid", "gid", "n").agg(F.first("bits").alias("bits")), "distinct")
    lists = stage(_lists(text, k, percent, last, bits, partitions(spark)), "lists")

    near = stage(_pivot_pairs(lists, sets, percent), "pairs")
    links = stage(_verify(text, near, k, percent), "links")
    label = components(links)
    rest = stage(_rest_pairs(lists, sets, label, percent), "pairs").join(near, ["a", "b"], "left_anti")
    more = stage(_verify(text, rest, k, percent), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    unstage(lists, near)

    member = described.select("doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("node"))
    linked = label.join(member.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), "node")
    named = linked.join(linked.groupBy("label").agg(F.min("least").alias("least")).withColumnRenamed("least", "component_id"), "label").select("node", "component_id")
    alone = sets.select(F.col("sid").alias("node")).join(label.select("node"), "node", "left_anti")
    alone = member.join(alone, "node").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    return member.join(named.unionByName(alone), "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _lists(text: DataFrame, k: int, percent: int, last, bits: int, parts: int) -> DataFrame:
    """(token, gid, n, rank) of prefix tokens that two groups or more have. A heavy token's members are spread over all
    ranges by group; all other tokens have few members by construction."""
    blocks = pa.schema([("range", pa.int64()), ("rows", pa.binary())])
    kind = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<u4"), ("rank", "<u4")])
    ranges = U(1 << bits)

    def flush(held, keys):
        rows, key = np.concatenate(held), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        s, c = runs(key)
        return batch(blocks, key[s].astype(np.int64), [rows[i : i + n].tobytes() for i, n in zip(s, c)])

    def deal(batches):
        seen: set[int] = set()
        held, keys, size = [], [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                g = shingles(t, k)
                if not len(g):
                    continue
                prefix, light = ordered_prefix(g, percent, last.value, bits)
                gid = group_id(prefix, len(g))
                if gid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(gid)
                rows = np.empty(len(prefix), kind)
                rows["token"], rows["gid"], rows["n"], rows["rank"] = prefix, gid, len(g), np.arange(len(prefix))
                key = mix(prefix) >> U(64 - bits)  # tokens of prefixes are small by choice
                key[light:] = ranges + U(gid + 2**63) % ranges
                held.append(rows)
                keys.append(key)
                size += len(rows)
                if size >= HELD // 4:
                    yield flush(held, keys)
                    held, keys, size = [], [], 0
        if size:
            yield flush(held, keys)

    out = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("n", pa.int64()), ("rank", pa.int64())])

    def meet(batches):
        for t in grouped(batches, "range"):
            rows = np.frombuffer(b"".join(t["rows"].to_pylist()), kind)
            rows = rows[np.lexsort((rows["gid"], rows["token"]))]
            tok, gid = rows["token"], rows["gid"]
            first = np.ones(len(rows), bool)
            first[1:] = (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1])
            rows = rows[first]
            if t["range"][0].as_py() < 1 << bits:
                s, c = runs(rows["token"])
                rows = rows[np.repeat(c > 1, c)]
            if len(rows):
                yield batch(out, rows["token"].astype(np.int64), rows["gid"], rows["n"].astype(np.int64), rows["rank"].astype(np.int64))

    dealt = map_arrow(text, deal, "range long, rows binary").repartition(parts, "range").sortWithinPartitions("range")
    return map_arrow(dealt, meet, "token long, gid long, n long, rank long")


def _overlap_needed(percent: int):
    """Least overlap with which sizes n and m link, as a Spark expression."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent))


def _pivot_pairs(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Set pairs (a < b): each member of a list with the list's pivots, and each set with the least set of its group."""
    pivot = lists.groupBy("token").agg(*(F.min(F.struct(F.xxhash64("gid", F.lit(s)).alias("h"), "gid", "n", "rank")).alias(f"p{s}") for s in SEEDS))
    each = lists.join(pivot, "token").select("gid", "n", "rank", F.explode(F.array(*(F.struct(F.col(f"p{s}.gid").alias("other"), F.col(f"p{s}.n").alias("m"), F.col(f"p{s}.rank").alias("at")) for s in SEEDS))).alias("p")).select("gid", "n", "rank", "p.*")
    left = F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("at"))
    each = each.where("gid <> other").where((100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (left >= _overlap_needed(percent)))
    groups = each.select(F.least("gid", "other").alias("g"), F.greatest("gid", "other").alias("h")).distinct()
    one = sets.groupBy("gid").agg(F.min(F.struct("sid", "n", "bits")).alias("s"), F.count("*").alias("k"))
    to = groups.union(groups.select("h", "g"))
    to = to.join(one.select(F.col("gid").alias("h"), "s"), "h").select(F.col("g").alias("gid"), "s")
    own = one.where("k > 1").select("gid", "s")
    pairs = sets.join(to.union(own), "gid").where("sid <> s.sid").select("sid", "n", "bits", F.col("s.sid").alias("other"), F.col("s.n").alias("m"), F.col("s.bits").alias("more"))
    pairs = pairs.where(_bits_allow(percent))
    return pairs.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def _bits_allow(percent: int):
    """The bitmaps' bound of the overlap reaches what a link needs. Compared in eight-byte pieces."""
    def piece(c, i):
        return F.conv(F.hex(F.substring(c, i * 8 + 1, 8)), 16, -10).cast("long")

    differ = sum((F.bit_count(piece("bits", i).bitwiseXOR(piece("more", i))) for i in range(BITS // 64)), F.lit(0))
    return F.floor((F.col("n") + F.col("m") - differ) / 2) >= _overlap_needed(percent)


def _rest_pairs(lists: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Set pairs of a list whose components differ and that the filters allow. The members of a long list are dealt into blocks; each two blocks, and each
    block with itself, are a unit of work of their own, so a token that many sets share is not one task's."""
    part = sets.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "gid", "n", "bits", F.coalesce("label", "sid").alias("part"))
    many = part.groupBy("gid").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("k"))
    ranged = lists.join(many, "gid")
    mixed = ranged.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("c")).where("lo <> hi and c > 2").select("token")
    rows = lists.join(mixed, "token").select("token", "gid", "rank")
    rows = rows.union(many.where("lo <> hi").select(F.xxhash64("gid").alias("token"), "gid", F.lit(0).cast("long")))
    rows = rows.join(part, "gid").select("token", "rank", "sid", "n", "bits", "part")
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = rows.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("unit", F.concat_ws(":", "token", F.least("block", "other"), F.greatest("block", "other"))).drop("token", "blocks")
    rows = rows.withColumn("across", F.col("block") != F.col("other")).drop("other")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def pair(batches):
        for t in grouped(batches, "unit"):
            block, across = t["block"].to_numpy(), t["across"][0].as_py()
            sid, n, rank = t["sid"].to_pylist(), t["n"].to_numpy(), t["rank"].to_numpy()
            code = {p: i for i, p in enumerate(dict.fromkeys(t["part"].to_pylist()))}
            part = np.array([code[p] for p in t["part"].to_pylist()])
            if len(code) < 2:
                continue
            sig = np.frombuffer(b"".join(t["bits"].to_pylist()), U).reshape(len(n), -1)
            order = np.argsort(n, kind="stable")
            n, rank, part, sig, block = n[order], rank[order], part[order], sig[order], block[order]
            a, b = [], []
            for i in range(len(n) - 1):
                end = np.searchsorted(n, 100 * n[i] // percent, "right")
                j = np.arange(i + 1, end)
                j = j[(part[j] != part[i]) & ((block[j] != block[i]) if across else True)]
                need = -(-percent * (n[i] + n[j]) // (100 + percent))
                j, need = (x[np.minimum(n[i] - rank[i], n[j] - rank[j]) >= need] for x in (j, need))
                differ = np.bitwise_count(sig[j] ^ sig[i]).sum(1, dtype=np.int64)
                j = j[(n[i] + n[j] - differ) // 2 >= need]
                for x in j:
                    p, q = sid[order[i]], sid[order[x]]
                    a.append(min(p, q))
                    b.append(max(p, q))
                if len(a) >= 50_000:
                    yield batch(out, a, b)
                    a, b = [], []
            if a:
                yield batch(out, a, b)

    spread = rows.repartition(partitions(rows.sparkSession), "unit").sortWithinPartitions("unit")
    return map_arrow(spread, pair, "a binary, b binary").distinct()


def _first_bytes(c: str):
    return F.conv(F.hex(F.substring(c, 1, 7)), 16, 10).cast("long").alias(c)


def _among(ranked: np.ndarray, x: int) -> bool:
    at = int(np.searchsorted(ranked, x))
    return at < len(ranked) and int(ranked[at]) == x


def _verify(text: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    spark = text.sparkSession
    asked = stage(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct(), "asked")
    few = asked.count() <= BROADCAST_ROWS
    # eight bytes a set; what passes by chance finds no partner in the joins below
    wanted = spark.sparkContext.broadcast(np.sort(asked.select(_first_bytes("sid")).toArrow()["sid"].to_numpy()) if few else None)
    schema = pa.schema([("sid", pa.binary()), ("tokens", pa.binary())])

    def whole(batches):
        seen = set()
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                g = shingles(t, k)
                sid = set_id(g)
                if len(g) and sid not in seen and (wanted.value is None or _among(wanted.value, int.from_bytes(sid[:7], "big"))):
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    rows.append((sid, g.tobytes()))
            if rows:
                yield batch(schema, *map(list, zip(*rows)))

    full = map_arrow(text, whole, "sid binary, tokens binary")
    full = full if few else full.join(asked, "sid", "left_semi")
    full = stage(full.groupBy("sid").agg(F.first("tokens").alias("tokens")), "whole")
    both = pairs.join(full.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a").join(full.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                z = np.sort(np.concatenate((x, y)))
                keep.append(can_link(len(x), len(y), int((z[1:] == z[:-1]).sum()), percent))
            yield batch(out, b.column("a"), b.column("b")).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, check, "a binary, b binary")

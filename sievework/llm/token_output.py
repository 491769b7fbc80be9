"""Token-ID output: texts are encoded with a public tokenizer and kept as Re-Pair grammar shards, in ascending doc_id order.

The file format is Parquet: a row is a shard (grammar.Shard in bytes) of up to `SHARD_IDS` ids of consecutive documents with their doc_ids and the least and
greatest of them, its range partition and its place there, and where its ids begin within that partition. Shards of a partition are made by one task and each
stands alone; Spark's committer publishes each task's files once, whichever attempt wins. Any document is decoded from its shard's rules
and its own symbols (read_documents).

Text is cut at ASCII white space before encoding, which the tokenizer drops anyway and across which it merges nothing, and signs are cut off words as
it does; each distinct piece is encoded once a worker, with add_special_tokens=False, and looked up by hash and length from then on.

Defined results: null and empty texts are the end id alone; null doc_ids come first; rows that repeat a doc_id stand side by
side, ordered by the bytes of their ids; an empty table has no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STAGED, batch, fits, map_arrow, partitions, shared_dir, stage, text_rows, unstage
from .grammar import Shard, compress
from .textnum import U, mix, prefix_sums, runs, word_spans

SHARD_IDS = 1 << 17
FILES = "part int, place int, begins long, n_ids long, least long, greatest long, doc_ids array<long>, data binary"
END = 1
#: Distinct pieces that a worker remembers; then it forgets all and goes on.
PIECES = 1_000_000
#: New pieces that are kept apart until they are sorted in with the others.
RECENT = 50_000
#: Letters-only pieces that are encoded as one text.
JOINED = 2_000
#: Bytes of texts that are encoded together.
CHUNK = 1 << 20
#: Signs at the end of a word that are looked at; a longer tail stays with its word.
TAIL = 4
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def pieces(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of a text begin and end: what stands between white space, and of that the ASCII signs after the last ASCII letter or
    digit apart, which the tokenizer splits off as well."""
    s, e = word_spans(b)
    sign = ~ALNUM & (np.arange(256) < 128)
    core, todo = e.copy(), np.flatnonzero(sign[b[e - 1]])
    for _ in range(TAIL):
        core[todo] -= 1
        todo = todo[core[todo] > s[todo]]
        todo = todo[sign[b[core[todo] - 1]]]
        if not len(todo):
            break
    tail = (core > s) & (core < e)
    tail[tail] = ALNUM[b[core[tail] - 1]]
    where = np.cumsum(1 + tail)
    starts, ends = np.empty(where[-1] if len(where) else 0, np.int64), np.empty(where[-1] if len(where) else 0, np.int64)
    first = where - 1 - tail
    starts[first], ends[first] = s, np.where(tail, core, e)
    starts[first[tail] + 1], ends[first[tail] + 1] = core[tail], e[tail]
    return starts, ends


class Encoder:
    """Encodes texts piece by piece. Ids of known pieces are looked up by a 64-bit hash and the length; new ones go to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        table = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(table.values()) + 1, bool)
        self.ends[[i for t, i in table.items() if t.endswith("</w>")]] = True
        # what the shortcuts rest on; another tokenizer gets whole stretches between white space, in their own case
        self.shares = self._ids("Ab,! ") == self._ids("ab") + self._ids(",!") and self._ids("a b") == self._ids("a") + self._ids("b")
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.known = (np.empty(0, U), *(np.empty(0, np.uint32) for _ in range(3)))  # hash, length, offset, ids
        self.recent = self.known
        self.ids, self.used = np.empty(1 << 20, self.kind), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of letters-only words, encoded as one text, and how many each has by where words end; None if they don't come apart so."""
        ids = np.array(self._ids(b" ".join(words).decode()), self.kind)
        cut = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(cut, prepend=-1)) if len(cut) == len(words) and cut[-1] == len(ids) - 1 else None

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        plain = np.array([w.isalpha() or not w.isascii() and w.decode().isalpha() for w in words]) if self.shares and self.ends.any() else np.zeros(len(words), bool)
        parts, counts, order = [], [], []
        letters, rest = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        for some in np.split(letters, range(JOINED, len(letters), JOINED)):
            found = self._plain([words[k] for k in some.tolist()]) if len(some) else None
            if found:
                parts.append(found[0])
                counts.append(found[1])
                order.append(some)
            else:
                rest.append(some)
        for some in np.split(rest := np.concatenate(rest), range(20_000, len(rest), 20_000)):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([words[k].decode() for k in some.tolist()], add_special_tokens=False)]
            parts.append(np.fromiter(itertools.chain.from_iterable(each), self.kind))
            counts.append(np.array([len(x) for x in each], np.int64))
            order.append(some)
        order, count, ids = np.concatenate(order), np.concatenate(counts), np.concatenate(parts)
        begins = np.empty(len(words), np.int64)
        begins[order], amount = np.cumsum(count) - count, np.empty(len(words), np.int64)
        amount[order] = count
        return ids[np.repeat(begins - np.cumsum(amount) + amount, amount) + np.arange(len(ids))], amount

    @staticmethod
    def _find(table, hashes, lengths) -> np.ndarray:
        """Index in table, -1 where there is none."""
        if not len(table[0]):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return np.where((table[0][at] == hashes) & (table[1][at] == lengths), at, -1)

    def _merge(self, a, b):
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b" ".join(texts) + b" "
        bounds = np.cumsum([len(t) + 1 for t in texts])
        b = np.frombuffer(raw, np.uint8)
        s, e = pieces(b) if self.shares else word_spans(b)
        c, power = prefix_sums(b)
        h, size = mix((c[e] - c[s]) * power[np.maximum(e, 1) - 1]), e - s
        order = np.argsort(h)
        first, count = runs(h[order])
        one = order[first]
        u, length = h[one], size[one]
        place, amount = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
        todo = np.ones(len(u), bool)
        for table in (self.known, self.recent):
            at = self._find(table, u, length)
            hit = at >= 0
            place[hit], amount[hit] = table[2][at[hit]], table[3][at[hit]]
            todo &= ~hit
        todo = np.flatnonzero(todo)
        if len(todo):
            more, amount[todo] = self._new([raw[i:j] for i, j in zip(s[one[todo]].tolist(), e[one[todo]].tolist())])
            place[todo] = self.used + np.cumsum(amount[todo]) - amount[todo]
            if self.used + len(more) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty(max(len(self.ids), len(more)), self.kind)))
            self.ids[self.used : self.used + len(more)] = more
            self.used += len(more)
            self.recent = self._merge(self.recent, (u[todo], *(x[todo].astype(np.uint32) for x in (length, place, amount))))
            if len(self.recent[0]) > RECENT:
                self.known, self.recent = self._merge(self.known, self.recent), tuple(x[:0] for x in self.recent)
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(np.arange(len(u)), count)
        n = amount[which]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(place[which] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        cut = np.concatenate(([0], upto))[np.searchsorted(s, bounds)]
        if len(self.known[0]) > PIECES:
            self.forget()
        return np.split(ids, cut[:-1])

    def encode(self, texts: list[bytes], end: int = END) -> list[np.ndarray]:
        # special tokens have signs in them: texts that may hold one are encoded as they are
        out: list[np.ndarray] = [np.array(self._ids(t.decode()), self.kind) if b"<|" in t else None for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        at = 0
        while at < len(rest):
            to, size = at, 0
            while to < len(rest) and (to == at or size + len(texts[rest[to]]) <= CHUNK):
                size += len(texts[rest[to]])
                to += 1
            for k, x in zip(rest[at:to], self._chunk([texts[k].lower() if self.shares else texts[k] for k in rest[at:to]])):
                out[k] = x
            at = to
        stop = np.array([end], self.kind)
        return [np.concatenate((x, stop)) for x in out]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One a worker process, for all its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Encode docs and write the shards to path."""
    spark = docs.sparkSession
    ids = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        coder = encoder(tokenizer)
        names, texts, size = [], [], 0
        for b in batches:
            names += b.column("doc_id").to_pylist()
            texts += b.column("text").to_pylist()
            size += b.column("text").nbytes
            if size >= CHUNK:
                yield batch(ids, names, [x.tobytes() for x in coder.encode(texts, end)])
                names, texts, size = [], [], 0
        if names:
            yield batch(ids, names, [x.tobytes() for x in coder.encode(texts, end)])

    encoded = stage(map_arrow(text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), encode, "doc_id long, ids binary"), "ids")
    kind = encoder(tokenizer).kind
    shards = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("begins", pa.int64()), ("n_ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])

    def pack(batches):
        part, place, begins = TaskContext.get().partitionId(), 0, 0
        held, names, size = [], [], 0

        def flush():
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
            shard = compress(np.concatenate(held), offsets)
            there = [d for d in names if d is not None]
            return batch(shards, [part], [place], [begins], [size], [min(there, default=None)], [max(there, default=None)], [names], [shard.to_bytes()])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                x = np.frombuffer(x, kind)
                if held and size + len(x) > SHARD_IDS:
                    yield flush()
                    held, names, place, begins, size = [], [], place + 1, begins + size, 0
                held.append(x)
                names.append(d)
                size += len(x)
        if held:
            yield flush()

    ordered = encoded.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    packed = map_arrow(ordered, pack, FILES)
    packed.write.option("compression", "zstd").parquet(path)
    unstage(encoded)


def read_ids(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, decoded shard by shard."""
    files = spark.read.schema(FILES).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    few = fits(sums)
    out = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for b in batches:
            for part, begins, names, data in zip(*(b.column(c).to_pylist() for c in ("part", "begins", "doc_ids", "data"))):
                ids, offsets = Shard.from_bytes(data).all_ids()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield batch(out, [part] * len(names), names, offsets[:-1] + begins, np.diff(offsets), crc)

    rows = map_arrow(files.select("part", "begins", "doc_ids", "data"), decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base) if few else base, F.col("part") == F.col("of")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents named. Only shards that hold one are read, and of those only the documents' own symbols are expanded."""
    wanted = sorted(set(doc_ids))
    files = spark.read.schema(FILES).parquet(path).where(functools.reduce(lambda a, b: a | b, [(F.col("least") <= d) & (F.col("greatest") >= d) for d in wanted], F.lit(False)))
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def decode(batches):
        for b in batches:
            for names, data in zip(b.column("doc_ids").to_pylist(), b.column("data").to_pylist()):
                at = [k for k, d in enumerate(names) if d in wanted]
                if at:
                    shard = Shard.from_bytes(data)
                    yield batch(out, [names[k] for k in at], [shard.document(k).tolist() for k in at])

    return map_arrow(files.select("doc_ids", "data"), decode, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    STAGED.append(path)
    write_ids(docs, tokenizer, path, end)
    return read_ids(spark, path)

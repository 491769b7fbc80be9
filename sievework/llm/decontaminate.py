"""Benchmark decontamination: rare n-gram seeds find places, Smith-Waterman alignment scores them.

Words are runs of ASCII letters and digits and all signs beyond ASCII, lower-cased. One scan of all documents does two things: it counts
the words that test items use, and looks every n-gram of the items up in the whole text. Where one stands, the text around it is put aside, as
hashes of the words of an item's length to either side. Then each n-gram gets the frequency expected of it if words were independent; it is a
seed unless the corpus would hold more than one per `common` documents by chance alone (how often the n-gram itself stands is no reason
to drop it: leaks are frequent). What was put aside for seeds, and has enough of the item's words, is aligned with the item (local alignment: match 2, mismatch -1, gap -1).
score is alignment score over the item's own, so an exact copy has 1 and an edited one less.

Defined results: (document, item) pairs with score >= min_score, best place of each; null or empty texts and items give none; items of
fewer than `n` words are looked up by their whole sequence; repeated rows give pairs of their own; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, stage, text_rows
from .textnum import PLAIN, U, mix, ngram_hashes, runs, word_hashes

#: Words of all items that a worker may be sent, 16 bytes each; more items are matched in several scans.
MOST_WORDS = 4_000_000


def words(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(PLAIN))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and where in text its alignment ends and about begins."""
    n = len(text)
    at = np.arange(n + 1)
    prev, best = np.zeros(n + 1, np.int64), (0, 0)
    start_prev = at.copy()
    begin = 0
    for w in item:
        diag = prev[:-1] + np.where(text == w, 2, -1)
        up = prev[1:] - 1
        row = np.zeros(n + 1, np.int64)
        start = at.copy()
        row[1:] = np.maximum(np.maximum(diag, up), 0)
        start[1:] = np.where(row[1:] == 0, at[1:], np.where(diag >= up, start_prev[:-1], start_prev[1:]))
        # a gap in the item costs 1 a word: running maximum of row + position
        lifted = row + at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        row, start = top - at, start[source]
        k = int(row.argmax())
        if row[k] > best[0]:
            best, begin = (int(row[k]), k), int(start[k])
        prev, start_prev = row, start
    return best[0], begin, best[1]


def within_reach(item: np.ndarray, text: np.ndarray, min_score: float) -> bool:
    """Whether enough of the item's words stand in text at all: no alignment scores more than 2 for each of them."""
    known = np.sort(text)
    at = np.minimum(np.searchsorted(known, item), len(known) - 1)
    return bool(len(known)) and int((known[at] == item).sum()) >= min_score * len(item)


class Items:
    """N-grams of test items, as arrays sorted for lookup."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        self.n = n
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.vocabulary = np.unique(np.concatenate([*self.words, np.empty(0, U)]))
        found = [(ngram_hashes(w, n), k) for k, w in enumerate(self.words) if len(w)]
        h = np.concatenate([h for h, _ in found] or [np.empty(0, U)])
        k = np.concatenate([np.full(len(h), k) for h, k in found] or [np.empty(0, int)])
        at = np.concatenate([np.arange(len(h)) for h, _ in found] or [np.empty(0, int)])
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], k[order], at[order]
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        # one bit for each of 2**20 values of a hash: most words and n-grams of a text end here
        self.word_gate, self.gate = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.word_gate[_gate(self.vocabulary)] = True
        self.gate[_gate(self.hash)] = True

    def rare(self, counts: np.ndarray, total: int, documents: int, common: float) -> np.ndarray:
        """Which n-grams, in order of hash, are seeds."""
        rate = np.log(np.maximum(counts, 1) / max(total, 1))
        out = np.zeros(len(self.hash), bool)
        expected = np.empty(len(self.hash))
        where = {(k, a): i for i, (k, a) in enumerate(zip(self.item.tolist(), self.at.tolist()))}
        for k, w in enumerate(self.words):
            if not len(w):
                continue
            r = rate[np.searchsorted(self.vocabulary, w)]
            size = min(self.n, len(w))
            e = np.exp(sum(r[i : i + len(w) - size + 1] for i in range(size))) * total
            place = np.array([where[k, a] for a in range(len(e))])
            expected[place] = e
            few = e * common <= max(documents, 1)
            out[place[few if few.any() else e == e.min()]] = True
        return out

    def places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram, shift of its item against the text) wherever an item's n-gram stands."""
        grams, shifts = [], []
        for size in self.sizes:
            if len(w) < size:
                continue
            h = np.full(len(w) - size + 1, U(size if size < self.n else 0))
            for i in range(size):
                h = h * U(0x9DDFEA08EB382D69) + w[i : i + len(h)]
            h = mix(h)
            hit = np.flatnonzero(self.gate[_gate(h)])
            lo, hi = np.searchsorted(self.hash, h[hit], "left"), np.searchsorted(self.hash, h[hit], "right")
            for j in np.flatnonzero(hi > lo):
                g = np.arange(lo[j], hi[j])
                grams.append(g)
                shifts.append(hit[j] - self.at[g])
        return (np.concatenate(grams), np.concatenate(shifts)) if grams else (np.empty(0, int), np.empty(0, int))

    def around(self, w: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, first word, words, n-grams found) of the pieces of a text that an item may align with."""
        gram, shift = self.places(w)
        if not len(gram):
            return []
        item = self.item[gram]
        order = np.lexsort((shift, item))
        gram, shift, item = gram[order], shift[order], item[order]
        out = []
        for i, m in zip(*runs(item)):
            size = len(self.words[item[i]])
            reach = size + 2 * (size // 2 + 2)
            new = np.flatnonzero(np.concatenate(([True], np.diff(shift[i : i + m]) > reach))) + i
            for a, b in zip(new, np.append(new[1:], i + m)):
                lo, hi = max(0, int(shift[a]) - size // 2 - 2), int(shift[b - 1]) + size + size // 2 + 2
                out.append((int(item[i]), lo, w[lo:hi], gram[a:b]))
        return out


def _gate(h: np.ndarray) -> np.ndarray:
    return (h >> U(44)).astype(np.int64)


def contaminated_pairs(docs: DataFrame, items: DataFrame, n: int = 3, common: float = 20.0, min_score: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of each document and item that align."""
    total_words = items.select(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total_words // (2 * MOST_WORDS)) or 1
    out = None
    numbered = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for part in range(parts):
        mine = numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else numbered
        got = mine.toArrow().sort_by([("item_id", "ascending")])
        found = _pairs(docs, Items(list(zip(got["item_id"].to_pylist(), got["text"].to_pylist())), n), common, min_score)
        out = found if out is None else out.unionByName(found)
    return out


def _pairs(docs: DataFrame, items: Items, common: float, min_score: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)  # MOST_WORDS words at most
    # rows of a piece: row (of its document), item, first word, words, n-grams; rows of a count: no item, and its word's place
    pieces = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("grams", pa.binary())])

    def scan(batches):
        it = shared.value
        seen, total, rows = np.zeros(len(it.vocabulary), np.int64), 0, 0
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            out = [[] for _ in pieces]
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = words(t)
                rows, total = rows + 1, total + len(w)
                known = w[it.word_gate[_gate(w)]]
                if len(known):
                    at = np.minimum(np.searchsorted(it.vocabulary, known), len(seen) - 1)
                    seen += np.bincount(at[it.vocabulary[at] == known], minlength=len(seen))
                for k, lo, piece, grams in it.around(w):
                    for c, x in zip(out, (d, base + rows, k, lo, None, piece.tobytes(), grams.astype(np.int32).tobytes())):
                        c.append(x)
            if out[0]:
                yield batch(pieces, *out)
        hit = np.flatnonzero(seen)
        at, n = np.concatenate((hit, [-1, -2])), np.concatenate((seen[hit], [total, rows]))
        none = [None] * len(at)
        yield batch(pieces, none, none, none, at, n, none, none)

    found = stage(map_arrow(text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), scan, "doc_id long, row long, item int, at long, n long, words binary, grams binary"), "pieces")
    got = found.where("item is null").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a word of the items, at most
    by = dict(zip(got["at"].to_pylist(), got["n"].to_pylist()))
    rare = spark.sparkContext.broadcast(items.rare(np.array([by.get(i, 0) for i in range(len(items.vocabulary))], float), by.get(-1, 0), by.get(-2, 0), common))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])

    def score(batches):
        it = shared.value
        for b in batches:
            out = [[] for _ in schema]
            for d, row, k, lo, w, grams in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "item", "at", "words", "grams"))):
                item, w = it.words[k], np.frombuffer(w, U)
                if rare.value[np.frombuffer(grams, np.int32)].any() and within_reach(item, w, min_score):
                    best, begin, end = align(item, w)
                    if best >= min_score * 2 * len(item):
                        for c, x in zip(out, (row, d, it.ids[k], best / (2 * len(it.words[k])), lo + begin, lo + end)):
                            c.append(x)
            yield batch(schema, *out)

    placed = map_arrow(found.where("item is not null").select("doc_id", "row", "item", "at", "words", "grams"), score, "row long, doc_id long, item_id long, score double, start_word long, end_word long")
    best = placed.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.s")).alias("start_word"), "b.end_word")

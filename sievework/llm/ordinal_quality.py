"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w.x). The weights w over hashed text features are shared by all grades and the
thresholds are ordered by construction (first threshold, then positive steps). x is the mean over a text's words of three
hashed indicators: the lower-cased word, the kinds of characters it is made of, and whether it repeats the word before.

It is fitted on a bounded sample of labelled documents (`max_labelled`, those of the smallest hash of doc_id) and
scores every whole text in one scan without a shuffle.

Defined results: a null or empty text has x = 0, so its score comes from the thresholds alone; rows that repeat a doc_id are scored
one by one; null doc_ids and extra columns pass; null grades are ignored. Without usable labels (fewer than two
distinct grades) every document gets tail probability 1.0 and is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, text_rows
from .textnum import SPACE, TABLE, U, mix, word_hashes, word_spans

DIM = 1 << 15
#: Kinds of bytes: 1 upper case, 2 lower case or beyond ASCII, 3 digits; every other sign is a kind of its own.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 1, 2, 2, 3


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[float, ...]

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one column a threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        g = np.asarray(self.grades)
        return g[0] + self.tails(z) @ np.diff(g)


def features(text: bytes) -> np.ndarray:
    """Indices into the weights, three a word (the third only for a repeated word)."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    h = word_hashes(text.lower())
    if not len(h):
        return np.empty(0, np.int64)
    s, e = word_spans(b)
    kind = KIND[b]
    first = np.ones(len(b), bool)
    first[1:] = (kind[1:] != kind[:-1]) | SPACE[b[:-1]]
    c = np.zeros(len(b) + 1, U)
    np.cumsum(np.where(first, TABLE[kind] >> U(8), U(0)), out=c[1:])
    shape = mix(c[e] - c[s])
    again = h[1:][h[1:] == h[:-1]]
    mask = U(DIM - 2)
    return np.concatenate((h & mask, shape & mask, np.full(len(again), DIM - 1, U))).astype(np.int64)


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 160, l2: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the negative log likelihood. x: indices and mean counts of each text."""
    grades, k = np.unique(y, return_inverse=True)
    n, m = len(y), len(grades) - 1
    rows = np.repeat(np.arange(n), [len(i) for i, _ in x])
    idx, val = np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])
    share = np.cumsum(np.bincount(k, minlength=m + 1))[:-1] / n
    logit = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(DIM), logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))))
    mean, var = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, th = p[:DIM], np.concatenate((p[DIM : DIM + 1], p[DIM] + np.cumsum(np.exp(p[DIM + 1 :]))))
        z = np.bincount(rows, val * w[idx], n)
        f = 1 / (1 + np.exp(np.clip(z[:, None] - th[None, :], -60, 60)))
        f = np.concatenate((np.zeros((n, 1)), f, np.ones((n, 1))), axis=1)
        at = np.arange(n)
        hi, lo = f[at, k + 1], f[at, k]
        d = f * (1 - f) / np.maximum(hi - lo, 1e-9)[:, None]
        gz = (d[at, k + 1] - d[at, k]) / n  # of the loss by z
        gt = np.zeros((n, m + 2))
        gt[at, k + 1] -= d[at, k + 1]
        gt[at, k] += d[at, k]
        gt = gt[:, 1:-1].sum(0) / n
        step = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate((np.bincount(idx, val * gz[rows], DIM) + l2 * w, step[:1], step[1:] * np.exp(p[DIM + 1 :])))
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        p = p - 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    th = np.concatenate((p[DIM : DIM + 1], p[DIM] + np.cumsum(np.exp(p[DIM + 1 :]))))
    return OrdinalModel(p[:DIM].copy(), th, tuple(float(g) for g in grades))


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = features(text)
    if not len(i):
        return i, np.empty(0)
    n = max(1, int((i < DIM - 1).sum()) // 2)
    u, c = np.unique(i, return_counts=True)
    return u, c / n


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_labelled: int = 4000) -> OrdinalModel | None:
    """Fit on at most `max_labelled` labelled documents; what comes to the driver has that bound."""
    rated = labels.select("doc_id", F.col(grade).cast("double").alias("grade")).where("doc_id is not null and grade is not null and not isnan(grade)")
    rated = rated.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.float64()), ("idx", pa.binary()), ("val", pa.binary())])

    def rows(batches):
        for b in batches:
            found = [counted(t) for t in b.column("text").to_pylist()]
            yield batch(schema, b.column("doc_id"), b.column("grade"), [i.astype(np.uint16).tobytes() for i, _ in found], [v.astype(np.float32).tobytes() for _, v in found])

    joined = text_rows(docs, "doc_id").join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text")
    got = map_arrow(joined, rows, "doc_id long, grade double, idx binary, val binary").toArrow().sort_by([("doc_id", "ascending")])
    y = got["grade"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    x = [(np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for i, v in zip(got["idx"].to_pylist(), got["val"].to_pylist(), strict=True)]
    return fit(x, y)


def scores(texts: list[bytes], model: OrdinalModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and the probability of the highest grade."""
    if model is None:
        return np.full(len(texts), np.nan), np.ones(len(texts))
    z = np.zeros(len(texts))
    for k, t in enumerate(texts):
        i = features(t)
        if len(i):
            z[k] = model.weights[i].sum() / max(1, int((i < DIM - 1).sum()) // 2)
    return model.expected(z), model.tails(z)[:, -1]


def score_documents(docs: DataFrame, model: OrdinalModel | None, min_tail: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, expected_grade (null without a model), tail_prob (of the highest grade), kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("kept", pa.bool_())])

    def rows(batches):
        for b in batches:
            e, p = scores(b.column("text").to_pylist(), model)
            yield batch(schema, b.column("doc_id"), pa.array(e, pa.float64(), mask=np.isnan(e)), p, p >= min_tail)

    return map_arrow(text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), rows, "doc_id long, expected_grade double, tail_prob double, kept boolean")


def keep_documents(docs: DataFrame, model: OrdinalModel | None, min_tail: float = 0.5) -> DataFrame:
    """The rows of docs that the model selects, in docs' own columns; rows are only filtered, never shuffled."""

    def rows(batches):
        for b in batches:
            _, p = scores([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()], model)
            yield b.filter(pa.array(p >= min_tail))

    return map_arrow(docs, rows, docs.schema)

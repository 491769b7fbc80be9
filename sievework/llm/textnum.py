"""Whole-text word hashing in numpy: words are maximal runs without ASCII white space, as in `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240607))
TABLE = _SEED.integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and bytes beyond ASCII stay, lower-cased; all else is a gap.
PLAIN = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: Powers that a worker keeps: as many as texts of this many bytes need; longer texts get their own.
KEPT = 1 << 21
_HELD: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of base."""
    out = _HELD.get(base, np.empty(0, U))
    if len(out) < n:
        out = np.ones(1 << max(16, (n - 1).bit_length()), U)
        m = 1
        while m < len(out):
            out[m : 2 * m] = out[:m] * U(pow(base, m, 2**64))
            m *= 2
        if len(out) <= KEPT:
            _HELD[base] = out
    return out


def prefix_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of TABLE[b[i]] * BASE**-i, and the powers that make a slice's sum independent of where it stands."""
    n = max(1, len(b))
    c = np.zeros(len(b) + 1, U)
    np.cumsum(TABLE[b] * _powers(pow(BASE, -1, 2**64), n)[: len(b)], out=c[1:])
    return c, _powers(BASE, n)


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[b], [True])).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, U)
    s, e = word_spans(b)
    c, power = prefix_sums(b)
    return mix((c[e] - c[s]) * power[e - 1])


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; of the whole sequence if it is shorter; none of no words."""
    if not len(words):
        return words
    k, short = min(k, len(words)), len(words) < k
    n = len(words) - k + 1
    h = np.full(n, U(k if short else 0))
    for i in range(k):
        h = h * U(0x9DDFEA08EB382D69) + words[i : i + n]
    return mix(h)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted x."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return s, np.diff(np.append(s, len(x)))


def ceil_div(a, b):
    return -(-a // b)

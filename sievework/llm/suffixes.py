"""Suffix order and longest-previous-factor arrays in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


def dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct ones."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])), dtype=np.uint32)
    return out


def ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at each position by its first `depth` bytes (at least 8); a shorter suffix is padded with zeros."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
    word = np.zeros(n, U)
    for i in range(8):
        word = (word << U(8)) | padded[i : i + n]
    r, have = dense(word), 8
    while have < depth:
        step = min(have, depth - have)
        ahead = np.zeros(n, np.uint32)
        ahead[: max(0, n - step)] = r[step:] + np.uint32(1)
        r = dense((r.astype(U) << U(32)) | ahead)
        have += step
    return r


def suffix_array(text: np.ndarray) -> np.ndarray:
    depth = 8
    while True:
        r = ranks(text, depth)
        if len(r) == 0 or int(r.max()) + 1 == len(r) or depth >= 2 * len(text) + 8:
            # what padding leaves equal differs by length: the shorter suffix is less
            return np.lexsort((-np.arange(len(text)), r))
        depth *= 2


def _previous(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if none: up a tree of minima to a left neighbour that has one, then down to the
    rightmost leaf that is smaller. All places take each step together."""
    n = len(values)
    m = 1 << max(1, (n - 1).bit_length()) if n else 1
    tree = np.full(2 * m, np.iinfo(np.int64).max)
    tree[m : m + n] = values
    level = m
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    out = np.full(n, -1)
    who, node = np.arange(n), np.arange(m, m + n)
    while len(who):
        hit = (node & 1 == 1) & (node > 1)
        hit[hit] = tree[node[hit] - 1] < values[who[hit]]
        down, at = who[hit], node[hit] - 1
        while len(at) and at[0] < m:  # one level for all of them
            right = 2 * at + 1
            at = np.where(tree[right] < values[down], right, right - 1)
        out[down] = at - m
        who, node = who[~hit], node[~hit] >> 1
        who, node = who[node > 1], node[node > 1]
    return out


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix order, the nearest places before and after whose position (`values`, all different) is smaller; -1 and n if none."""
    values = np.asarray(values, np.int64)
    return _previous(values), len(values) - 1 - _previous(values[::-1])[::-1]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, `most` at the most; eight bytes at a time, for those that still agree."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(most + 16, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (n + most + 8, 8), (1, 1))
    out = np.minimum(most, n - np.maximum(a, b))
    todo, at = np.arange(len(a)), 0
    while len(todo) and at < most:
        x = words[a[todo] + at].view(U).ravel() ^ words[b[todo] + at].view(U).ravel()
        differ = x != 0
        low = x[differ] & (~x[differ] + U(1))  # the lowest bit that differs, in the first byte that does
        same = at + np.bitwise_count(low - U(1)).astype(np.int64) // 8
        out[todo[differ]] = np.minimum(out[todo[differ]], same)
        todo, at = todo[~differ], at + 8
    return out


def previous_factors(text: np.ndarray, starts: np.ndarray, earlier: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For the suffixes at `starts` the length (`most` at the most) of the longest match with one that is earlier, as the numbers `earlier` (all different) say.
    order: these suffixes in suffix order by `most` bytes or more. The best match is with the previous or the next smaller one in that order."""
    placed, at = earlier[order], starts[order]
    out = np.zeros(len(order), np.int64)
    for near in smaller(placed):
        there = np.flatnonzero((near >= 0) & (near < len(order)))
        out[there] = np.maximum(out[there], common(text, at[there], at[near[there]], most))
    back = np.empty(len(order), np.int64)
    back[order] = out
    return back


def longest_previous_factor(text: bytes) -> np.ndarray:
    """For each position of a text the length of the longest match that begins earlier."""
    t = np.frombuffer(text, np.uint8)
    every = np.arange(len(t))
    return previous_factors(t, every, every, suffix_array(t), len(t))


def repeated_windows(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows text[starts : starts + length] stand earlier as well, by (doc, at): those whose longest previous factor reaches `length`."""
    earlier = np.empty(len(starts), np.int64)
    earlier[np.lexsort((at, doc))] = np.arange(len(starts))
    order = np.argsort(ranks(text, length)[starts], kind="stable")
    return previous_factors(text, starts, earlier, order, length) >= length

"""Re-Pair grammars over token ids.

A shard is a sequence of ids cut into documents. Pairs of neighbours that lie within one document are counted; the most frequent are replaced, left to
right without overlap, by new symbols, and so on with the pairs that arise, until no pair stands `LEAST` times: a rule is two symbols
and a length, so a pair that stands twice saves nothing. Rules hold symbols of earlier rules, to any depth. Each round replaces all pairs that stand at least
`limit` times, and the limit falls by `FALL` where none is left, so frequent pairs go first without one round a pair.

Symbols 0 to n - 1 are the shard's own distinct ids, the rest its rules; all numbers take as many bits as the largest of their kind needs. The length that each
rule expands to is kept, so a document is decoded from the rules and its own symbols alone, each id written straight to its place.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .textnum import runs

U = np.uint64
MAGIC = b"RPG2"
HEAD = "<4sIIQIBBBB"
LEAST = 3
FALL = 8


def pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bits (32 at most) of each number, one after the other."""
    bits = np.unpackbits(x.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def packed_size(n: int, width: int) -> int:
    return -(-n * width // 8)


def unpack(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, packed_size(n, width), at), count=n * width).reshape(n, width)
    return np.packbits(bits).view(">u4").astype(np.int64)


def _width(x: np.ndarray) -> int:
    return max(1, int(x.max()).bit_length()) if len(x) else 1


@dataclass(frozen=True)
class Shard:
    ids: np.ndarray  # of symbols that are no rules
    rules: np.ndarray  # (n, 2) symbols
    lengths: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray
    offsets: np.ndarray  # of documents in symbols, one more than documents

    def to_bytes(self) -> bytes:
        sizes = np.diff(self.offsets)
        parts = (self.ids, self.rules.ravel(), self.lengths, sizes, self.symbols)
        top = max(1, (len(self.ids) + len(self.rules) - 1).bit_length())
        widths = (_width(self.ids), top, _width(self.lengths), _width(sizes), top)
        head = struct.pack(HEAD, MAGIC, len(self.ids), len(self.rules), len(self.symbols), len(sizes), *widths[:4])
        return head + b"".join(map(pack, parts, widths))

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        magic, ids, rules, symbols, docs, *widths = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        at, out = struct.calcsize(HEAD), []
        for n, width in zip((ids, 2 * rules, rules, docs, symbols), (*widths, widths[1])):
            out.append(unpack(data, n, width, at))
            at += packed_size(n, width)
        return Shard(out[0], out[1].reshape(-1, 2), out[2], out[4], np.concatenate(([0], np.cumsum(out[3]))))

    def sizes(self) -> np.ndarray:
        """Ids that each symbol expands to."""
        return np.concatenate((np.ones(len(self.ids), np.int64), self.lengths))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols. Where all rules written out are shorter than that, they are first, and copied."""
        size = self.sizes()
        total = np.cumsum(size[symbols])
        if not len(total) or int(self.lengths.sum()) > total[-1]:
            return self._written(symbols)
        whole, begins = self._written(np.arange(len(size))), np.cumsum(size) - size
        return whole[np.repeat(begins[symbols] - total + size[symbols], size[symbols]) + np.arange(total[-1])]

    def _written(self, symbols: np.ndarray) -> np.ndarray:
        """Each symbol has its place in the result; a rule hands its place to its left and the one behind that to its right."""
        size, n = self.sizes(), len(self.ids)
        at = np.cumsum(size[symbols])
        out = np.empty(int(at[-1]) if len(at) else 0, np.int64)
        at -= size[symbols]
        while len(symbols):
            plain = symbols < n
            out[at[plain]] = self.ids[symbols[plain]]
            rest, at = symbols[~plain] - n, at[~plain]
            left, right = self.rules[rest, 0], self.rules[rest, 1]
            symbols, at = np.concatenate((left, right)), np.concatenate((at, at + size[left]))
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[k] : self.offsets[k + 1]])

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each begins and the last ends."""
        return self.expand(self.symbols), np.concatenate(([0], np.cumsum(self.sizes()[self.symbols])))[self.offsets]


def _buckets(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash bucket of each pair, and how many pairs each bucket has; a pair with a 0 is in none."""
    h = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int64)
    h[(a == 0) | (b == 0)] = 1 << bits
    count = np.bincount(h, minlength=(1 << bits) + 1)
    count[-1] = 0
    return h, count


def _frequent(seq: np.ndarray, at: np.ndarray | None, limit: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs at the places `at` (ascending; None: everywhere) those that stand `limit` times or more there: their places, and a number for
    each distinct one. Counts in hash buckets leave few pairs to be sorted."""
    a, b = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
    if len(a) > 4096:
        h, count = _buckets(a, b, 18 if limit < 16 else 16)
        some = np.flatnonzero((count >= limit)[h])
    else:
        some = np.flatnonzero((a > 0) & (b > 0))
    wide, bits = U(top.bit_length()), U(len(some).bit_length())
    code = (a[some].astype(U) << wide) | b[some]
    if 2 * wide + bits <= 64:  # sorting numbers is much faster than sorting places
        both = np.sort((code << bits) | np.arange(len(some), dtype=U))
        order, code = (both & ((U(1) << bits) - U(1))).astype(np.int64), both >> bits
    else:
        order = np.argsort(code)
        code = code[order]
    start, n = runs(code)
    much = n >= limit
    place = np.repeat(much, n)
    which = np.full(len(some), -1, np.int32)
    which[order[place]] = np.repeat(np.arange(int(much.sum()), dtype=np.int32), n[much])
    keep = which >= 0
    return (some if at is None else at[some])[keep], which[keep]


def _apart(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the places (ascending) of pairs are replaced: of overlapping ones the more frequent, then left to right."""
    touch = np.diff(at) == 1
    before, after = np.zeros_like(count), np.zeros_like(count)
    before[1:][touch] = count[:-1][touch]
    after[:-1][touch] = count[1:][touch]
    taken = (count > before) & (count >= after)
    near = taken.copy()
    near[1:] |= taken[:-1] & touch
    near[:-1] |= taken[1:] & touch
    left = np.flatnonzero(~near)
    if len(left):  # every other one of each run
        fresh = np.flatnonzero(np.concatenate(([True], np.diff(at[left]) > 1)))
        within = np.arange(len(left)) - np.repeat(fresh, np.diff(np.append(fresh, len(left))))
        taken[left[within % 2 == 0]] = True
    return taken


def compress(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> Shard:
    """ids of all documents and their offsets (one more than documents)."""
    ids = np.asarray(ids, np.int64)
    there = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    there[ids] = True
    known = np.flatnonzero(there)
    # symbols are one higher while pairs are sought, as a 0 stands after each document
    seq = np.zeros(len(ids) + len(offsets) - 1, np.uint32)
    seq[np.arange(len(ids)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = np.cumsum(there, dtype=np.uint32)[ids]
    rules, top, near = [np.empty((0, 2), np.int64)], len(known) + 1, None
    limit = max(least, int(_buckets(seq[:-1], seq[1:], 16)[1].max()) // FALL) if len(seq) > 1 else least
    while len(seq) > 1:
        at, which = _frequent(seq, near, limit, top)
        taken = np.zeros(len(at), bool)
        while len(at):
            n = np.bincount(which)
            taken = _apart(at, n[which])
            # a pair that others leave fewer than `least` places gets no rule
            used = np.bincount(which[taken], minlength=len(n)) >= least
            if used.any():
                taken &= used[which]
                break
            # all are in each other's way: the most frequent alone, or the others without it
            one = which == n.argmax()
            alone = _apart(at[one], n[which[one]])
            if alone.sum() >= least:
                at, which, taken, used = at[one], np.zeros(int(one.sum()), np.int64), alone, np.ones(1, bool)
                break
            at, which, taken = at[~one], np.unique(which[~one], return_inverse=True)[1], taken[~one]
        if not taken.any():
            if limit == least and near is None:
                break
            near, limit = None, max(least, limit // FALL)
            continue
        at, which = at[taken], (np.cumsum(used) - 1)[which[taken]]
        new = np.empty((int(which.max()) + 1, 2), np.int64)
        new[which, 0], new[which, 1] = seq[at], seq[at + 1]
        rules.append(new)
        seq[at] = top + which
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        # other pairs only got fewer: those that may be frequent now have a new symbol
        fresh = seq >= top
        fresh[:-1] |= fresh[1:]
        fresh[-1] = False
        near = np.flatnonzero(fresh)
        top += len(new)
    size = np.ones(top - 1, np.int64)
    done = len(known)
    for r in rules:
        size[done : done + len(r)] = size[r[:, 0] - 1] + size[r[:, 1] - 1]
        done += len(r)
    ends = np.flatnonzero(seq == 0)
    return Shard(known, np.concatenate(rules) - 1, size[len(known) :], seq[seq > 0].astype(np.int64) - 1, np.concatenate(([0], ends - np.arange(len(ends)))))

"""License scans by ordered signature rules.

A text is reduced to its lower-cased words. Rules (license_rules) whose keyword isn't among the bytes are not tried.
Matches begin and end at words. A match that lies within one of higher priority, or that is the same as it, is suppressed; matches that overlap in part both
stay. Rules are taken by falling priority, and those that decide are kept as intervals of which none lies within another, in order, so each
match is one bisection. score is the chance that any of the remaining detections is right, each taken
with its rule's confidence; base phrases that no detection covers count 0.5.

Base phrases are counted wherever their words stand consecutively, however rules decide.

Defined results: null and empty texts and texts without words have no places, empty label lists, null first_word and last_word and
score 0; repeated rows, null doc_ids and extra columns pass.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, text_rows
from .license_rules import rules
from .textnum import PLAIN

PHRASES = ((b" cc by ", "cc-by"), (b" general public license ", "gpl"), (b" all rights reserved ", "reserved"))


@functools.lru_cache(1)
def compiled() -> tuple[list[bytes], list[tuple[int, str, float, bytes, re.Pattern]]]:
    made = [(k, label, conf, word, re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")) for k, (label, conf, word, pattern) in enumerate(rules())]
    return sorted({w for *_, w, _ in made}), made


def places(flat: bytes, phrase: bytes) -> list[int]:
    """Where phrase's first word begins in flat, overlaps included."""
    out, at = [], flat.find(phrase)
    while at >= 0:
        out.append(at + 1)
        at = flat.find(phrase, at + 1)
    return out


def detections(flat: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of matches that no other suppresses, by start. flat: words with a space around each."""
    words, made = compiled()
    there = {w for w in words if w in flat}
    starts: list[int] = []  # of matches found so far that lie in no other; both lists rise
    ends: list[int] = []
    kept: list[tuple[int, int, str, float]] = []
    for _, label, conf, word, pattern in made:
        if word not in there:
            continue
        for m in pattern.finditer(flat):
            s, e = m.span()
            k = bisect_right(starts, s)
            if k and ends[k - 1] >= e:
                continue
            kept.append((s, e, label, conf))
            lo, hi = bisect_left(starts, s), bisect_right(ends, e)
            starts[lo : max(lo, hi)], ends[lo : max(lo, hi)] = [s], [e]
    return sorted(kept)


def scan(text: bytes) -> tuple:
    words = text.translate(PLAIN).split()
    flat = b" " + b" ".join(words) + b" "
    base = [(p, label) for phrase, label in PHRASES for p in places(flat, phrase)]
    kept = detections(flat)
    begins, upto = [s for s, *_ in kept], list(itertools.accumulate((e for _, e, *_ in kept), max))
    bare = sum(1 for p, _ in base if not (k := bisect_right(begins, p)) or upto[k - 1] <= p)
    miss = math.prod(1 - conf for _, _, _, conf in kept) * 0.5**bare
    at = [flat.count(b" ", 0, p) - 1 for p in (min(base)[0], max(base)[0])] if base else [None, None]
    own = sorted({label for _, label in base})
    return len(words), len(base), *at, ",".join(own), ",".join(sorted({*own, *(d[2] for d in kept)})), 1 - miss


def find_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def rows(batches):
        for b in batches:
            found = [scan(t) for t in b.column("text").to_pylist()]
            yield batch(schema, b.column("doc_id"), *(map(list, zip(*found)) if found else [[]] * 7))

    return map_arrow(text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

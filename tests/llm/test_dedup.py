"""Suffix-array dedup and the Jaccard join, against brute force."""

import hashlib
import inspect
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import jaccard_join as J
from sievework.llm import queries
from sievework.llm import substring_dedup as S
from sievework.llm import suffixes

SCHEMA = "doc_id long, text string, uid string, node string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def removed_by_hand(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def messy(seed):
    rng = random.Random(seed)
    shared = [words(rng, 40) for _ in range(4)]
    rows = []
    for i in range(60):
        t = words(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            t = t[: len(t) // 2] + s[a : a + rng.randrange(90, 220)] + t[len(t) // 2 :]
        rows.append((i, t))
    rows += [(100 + i, rows[i % 3][1]) for i in range(20)]  # copies
    rows += [(200, "ab" * 300), (201, "ab" * 200), (202, "é" * 120), (203, "x" * 99), (204, "x" * 100), (205, ""), (206, None), (207, " \n\t"), (208, "日本" * 40 + words(rng, 30))]
    return rows


def test_dedup_equals_brute_force(spark):
    rows = messy(1)
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup(frame(spark, rows)).collect()}
    assert got == removed_by_hand(rows)


def test_dedup_of_a_hot_passage_and_many_copies(spark):
    rng = random.Random(2)
    hot = words(rng, 60)
    rows = [(i, f"{words(rng, 5)} {hot} {words(rng, 5)}") for i in range(400)] + [(1000 + i, hot) for i in range(300)]
    assert {r.doc_id: tuple(r)[1:] for r in S.dedup(frame(spark, rows, 9)).collect()} == removed_by_hand(rows)


def test_dedup_takes_a_long_text_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(0, words(rng, 3000)), (1, words(rng, 200))]
    rows.append((2, rows[1][1][50:400] + rows[0][1][5000:9000]))
    whole = S.super_windows(np.frombuffer(rows[0][1].encode(), np.uint8), 100)
    assert whole[2].sum() == len(rows[0][1]) - 99 and (np.diff(whole[1]) == whole[2][:-1]).all()
    assert {r.doc_id: tuple(r)[1:] for r in S.dedup(frame(spark, rows)).collect()} == removed_by_hand(rows)


def test_copies_found_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 5)
    rows = messy(3)
    rows += [(1000 + i, rows[3][1]) for i in range(9)] + [(2000 + i, rows[5][1]) for i in range(3)]
    assert {r.doc_id: tuple(r)[1:] for r in S.dedup(frame(spark, rows)).collect()} == removed_by_hand(rows)


def test_dedup_of_odd_rows(spark):
    a, b = "a" * 50 + "b" * 60, "c" * 130
    rows = [(1, a), (1, a), (1, b), (None, a), (None, None), (0, b)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.dedup(frame(spark, rows)).collect()))
    first_b = removed_by_hand([(0, b)])[0][1]
    assert got == [(False, 0, 130, first_b), (False, 1, 110, 0), (False, 1, 110, 0), (False, 1, 130, 130), (True, 0, 0, 0), (True, 0, 110, 110)]
    assert S.dedup(frame(spark, [])).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in S.dedup(frame(spark, [(0, a), (1, "z" + a)]), keep_bytes=True).collect()}
    assert kept == {0: a.encode(), 1: b"z"}
    with pytest.raises(ValueError):
        S.dedup(frame(spark, []), length=10)


def test_a_minimizer_that_many_texts_share_is_spread(spark, monkeypatch):
    rng = random.Random(5)
    hot = words(rng, 22)
    rows = [(i, f"{words(rng, 9)} {hot[rng.randrange(0, 12):]}{words(rng, 3)}") for i in range(600)]
    want = removed_by_hand(rows)
    for limit in (S.HOT, 8):
        monkeypatch.setattr(S, "HOT", limit)
        source = inspect.getsource(S._compared)
        assert "repeated_windows" in source
        assert {r.doc_id: tuple(r)[1:] for r in S.dedup(frame(spark, rows, 5)).collect()} == want
    met = S._met(frame(spark, rows).selectExpr("doc_id as uid", "cast(text as binary) as text"), 100, 8, 4)
    assert met.where("hot and hash is not null").count() > 500


def test_ten_thousand_texts_of_one_minimizer():
    rng = np.random.default_rng(7)
    core = rng.integers(97, 123, 60, dtype=np.uint8)
    few = lambda n: rng.integers(97, 99, n, dtype=np.uint8)
    rows = [np.concatenate((np.full(30, 120, np.uint8), few(10), core, np.full(15, 121, np.uint8), few(5))) for _ in range(10_000)]
    text = np.concatenate(rows)
    starts = (np.arange(10_000)[:, None] * 120 + np.arange(21)[None, :]).ravel()
    doc, at = np.repeat(rng.permutation(10_000), 21), np.tile(np.arange(21), 10_000)
    got = suffixes.repeated_windows(text, starts, doc, at, 100)
    seen, want, raw = set(), np.zeros(len(starts), bool), text.tobytes()
    for k in np.lexsort((at, doc)).tolist():
        w = raw[starts[k] : starts[k] + 100]
        want[k] = w in seen
        seen.add(w)
    assert np.array_equal(got, want) and got.any() and not got.all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), unique=True, max_size=60))
def test_smaller_positions(values):
    before, after = suffixes.smaller(np.array(values, np.int64))
    for i, v in enumerate(values):
        assert before[i] == max((j for j in range(i) if values[j] < v), default=-1)
        assert after[i] == min((j for j in range(i + 1, len(values)) if values[j] < v), default=len(values))


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=40))
def test_longest_previous_factors(text):
    b = text.encode()
    order = suffixes.suffix_array(np.frombuffer(b, np.uint8)).tolist()
    assert order == sorted(range(len(b)), key=lambda i: b[i:])
    want = [max((next((k for k in range(len(b)) if i + k >= len(b) or b[i + k] != b[j + k]), 0) for j in range(i)), default=0) for i in range(len(b))]
    assert suffixes.longest_previous_factor(b).tolist() == want


def classes_by_hand(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0, len(sets[i]), (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[f"e{rng.randrange(10**6)}"], [], [w[at], f"e{rng.randrange(10**6)}"]])
    return " ".join(w)


def near(seed, members=60):
    rng = random.Random(seed)
    rows, base = [], [words(rng, rng.choice([5, 30, 120, 300]), 10**5) for _ in range(30)]
    passage = words(rng, 55, 10**5)
    for b in base:
        rows += [edited(rng, b, rng.randrange(0, 6)) for _ in range(rng.randrange(1, 5))]
    rows += [edited(rng, base[-1] + " " + words(rng, 80, 10**5), rng.randrange(0, 5)) for _ in range(10)]
    hot = words(rng, 110, 10**5)
    rows += [edited(rng, hot, rng.randrange(0, 5)) for _ in range(members)] + [hot.upper()] * 25
    rows += [words(rng, 20, 10**5) + " " + passage for _ in range(50)]
    rows += ["a", "a", "A b", "a  b\n", "a b c", "", None, "   ", "A b c d", "a b\x0bc\x0cd", "é b c d", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,heavy,block", [(1, 32, 5), (2, 4, 1000), (3, 10**9, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, heavy, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near(seed)
    got = [(r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_classes(frame(spark, rows), heavy=heavy).collect()]
    assert sorted(got, key=str) == classes_by_hand(rows)


def test_classes_of_odd_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "x y"), (None, "q"), (7, None)]
    got = [(r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_classes(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == classes_by_hand(rows)
    assert J.jaccard_classes(frame(spark, [])).count() == 0


def test_all_pairs_of_a_list_meet_once_whatever_its_blocks(spark, monkeypatch):
    sets = spark.createDataFrame([(bytes([i]), i, 100, bytes(J.BITS // 8)) for i in range(40)], "sid binary, gid long, n long, bits binary")
    lists = spark.createDataFrame([(7, i, 100, 0) for i in range(40)], "token long, gid long, n long, rank long")
    label = spark.createDataFrame([(bytes([i]), bytes([i % 3])) for i in range(30)], "node binary, label binary")
    part = lambda i: i % 3 if i < 30 else i
    want = {(bytes([i]), bytes([j])) for i in range(40) for j in range(i + 1, 40) if part(i) != part(j)}
    for block in (1, 7, 1000):
        monkeypatch.setattr(J, "BLOCK", block)
        got = [tuple(map(bytes, r)) for r in J._rest_pairs(lists, sets, label, 85).collect()]
        assert len(got) == len(want) and set(got) == want


def test_other_widths_and_thresholds(spark):
    rows = near(4, 20)
    got = [(r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_classes(frame(spark, rows), k=5, percent=80).collect()]
    assert sorted(got, key=str) == classes_by_hand(rows, 5, 80)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        differ = int(np.bitwise_count(np.frombuffer(J.bitmap(a), np.uint8) ^ np.frombuffer(J.bitmap(b), np.uint8)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))

"""Decontamination, mixing, token output and the pipeline."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import decontaminate as B
from sievework.llm import mixture as M
from sievework.llm import token_output as O
from sievework.llm.common import without
from sievework.llm.grammar import Shard, compress

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None if t is None else len(t), "?") for i, t, s in rows], SCHEMA)


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_textbook():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        score, begin, end = B.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == smith_waterman(a, b) and 0 <= begin <= end <= len(b)
        assert smith_waterman(a, b[begin:end]) == score


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(30000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 50)))) for i in range(20)] + [(50, None), (51, ""), (52, "two words")]
    rows, want = [], set()
    for d in range(300):
        t = [word() for _ in range(rng.randrange(20, 300))]
        if d % 3 == 0:
            k = rng.randrange(20)
            leak = items[k][1].split()
            if d % 6 == 0:  # edited: a tenth of the words
                for _ in range(len(leak) // 10):
                    leak[rng.randrange(len(leak))] = word()
            t[5:5] = ("; ".join(leak)).upper().split(" ")
            want.add((d, k))
        rows.append((d, " ".join(t), "s"))
    rows += [(900, None, "s"), (901, "", None), (902, "x " * 20000 + items[3][1], "s"), (903, items[4][1], "s"), (903, items[4][1], "s"), (None, items[5][1], "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in B.contaminated_pairs(frame(spark, rows), table).collect()]
    assert sorted(p for p in got if p[0] is not None) == sorted([*want, (902, 3), (903, 4), (903, 4)]) and (None, 5) in got
    assert B.contaminated_pairs(frame(spark, []), table).count() == 0 and B.contaminated_pairs(frame(spark, rows), table.limit(0)).count() == 0


def targets_by_hand(totals):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * totals[s]}
        if not over:
            return full | {s: left * weight[s] / w for s in open_}
        for s in over:
            full[s] = 2 * totals[s]
            left -= full[s]
        open_ -= over
    return full


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    sources = [None, "a", "b", "B", "é", "zz", "empty"]
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.1)) % 3000)), rng.choices(sources[:6], [1, 9, 1, 3, 1, 2])[0]) for i in range(500)]
    rows += [(1000 + i, None, "empty") for i in range(3)] + [(2000 + i, "a\0 " * (i + 9), "nul") for i in range(3)]
    got = M.mix(frame(spark, rows)).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals: dict = {}
    for i, s in source.items():
        totals[s] = totals.get(s, 0) + size[i]
    want = targets_by_hand(totals)
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and r.target == pytest.approx(want[s], abs=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert {s: taken[s] for s in taken} == {s: int(want[s] + 1e-9) for s in taken}
    assert sorted(map(str, M.mix(frame(spark, rows[::-1])).collect())) == sorted(map(str, got))
    texts = M.mixed_documents(frame(spark, rows))
    assert texts.columns == frame(spark, rows).columns
    words: dict = {}
    for r in texts.collect():
        whole = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert ("\0" in whole or whole.startswith(r.text or "")) and (r.n_chars or 0) == len(r.text or "")
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert words == {r.doc_id: r.taken for r in got if r.taken or r.doc_id in words}


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c\x0bd", None), (2, "", "y"), (3, None, None)]
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size for r in got)
    assert M.mix(frame(spark, [])).count() == 0 and M.mixed_documents(frame(spark, [])).count() == 0


def replaced(docs, pair, new):
    out, n = [], 0
    for d in docs:
        x, i = [], 0
        while i < len(d):
            if i + 1 < len(d) and (d[i], d[i + 1]) == pair:
                x.append(new)
                i, n = i + 2, n + 1
            else:
                x.append(d[i])
                i += 1
        out.append(x)
    return out, n


def repair_by_hand(docs, least):
    """Re-Pair, one most frequent pair after the other: symbols left, and rules."""
    rules = 0
    while True:
        found = max(((replaced(docs, p, -1)[1], p) for p in {(a, b) for d in docs for a, b in zip(d, d[1:])}), default=(0, None))
        if found[0] < least:
            return sum(map(len, docs)), rules
        rules += 1
        docs = replaced(docs, found[1], 1000 + rules)[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), max_size=12), st.integers(2, 5))
def test_grammars_decode_to_what_they_hold(docs, least):
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    s = Shard.from_bytes(compress(ids, offsets, least).to_bytes())
    assert [s.document(k).tolist() for k in range(len(docs))] == docs
    every, at = s.all_ids()
    assert every.tolist() == ids.tolist() and at.tolist() == offsets.tolist()
    assert [len(s.expand(np.array([len(s.ids) + k]))) for k in range(len(s.rules))] == s.lengths.tolist()
    # no pair is left that stands `least` times, and each rule is used as often or within others
    left = [s.symbols[i:j].tolist() for i, j in zip(s.offsets[:-1], s.offsets[1:])]
    assert all(replaced(left, p, -1)[1] < least for p in {(a, b) for d in left for a, b in zip(d, d[1:])})
    by_hand = repair_by_hand(docs, least)
    assert len(s.symbols) + len(s.rules) <= 1.35 * sum(by_hand) + 4


def test_grammars_equal_the_plain_method_where_no_pairs_compete():
    docs = [[1, 2, 3, 4, 5, 6, 7, 8], [9, 1, 2, 3, 4], [1, 2, 3, 4, 9, 5, 6], [1, 2, 5, 6, 9]]
    s = compress(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert (len(s.symbols), len(s.rules)) == repair_by_hand(docs, 3) and (s.rules >= len(s.ids)).any()


def test_grammars_are_deep_and_smaller_than_plain_ids(spark):
    ids = np.tile(np.arange(8), 1000)
    assert len(compress(ids, np.array([0, len(ids)])).to_bytes()) < 100
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(1500).collect()
    ids = [O.Encoder(TOKENIZER).encode([(r.text or "").encode() for r in docs])][0]
    offsets = np.cumsum([0, *map(len, ids)])
    s = compress(np.concatenate(ids), offsets)
    depth = np.ones(len(s.ids) + len(s.rules), int)
    for k, (a, b) in enumerate(s.rules.tolist()):
        depth[len(s.ids) + k] = 1 + max(depth[a], depth[b])
    assert depth.max() > 6 and len(s.to_bytes()) < 0.65 * 2 * offsets[-1]
    assert np.array_equal(Shard.from_bytes(s.to_bytes()).document(700), ids[700])


HARD = ["Hello, World!", "l'État c'est moi", "a.b", "x... y!!! z?!", "é,", "»., n", "ÀÉ İstanbul ǅ ß ΑΣ", "tab\tnew\nline\x0bvt\x0cff", "no break space", "日本語テキスト", "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>",
        "don't it's we'll", "é x́.", "123,456.78", "a\x1cb\x85c", "PASS!! THE,!! %%% ###", "﻿bom", "1st 2nd", "foo_bar-baz", "🙂🙂 ok.", "'s 's.", "x'", " ", "."]


def test_encoding_equals_the_tokenizer():
    t, rng = Tokenizer.from_file(TOKENIZER), random.Random(3)
    texts = HARD + [" ".join(rng.choice(HARD) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["".join(rng.choice("abcÉñ.,!'\" \n7<|>") for _ in range(60)) for _ in range(300)] + ["", "word " * 5000]
    coder = O.Encoder(TOKENIZER)
    assert coder.shares
    for _ in range(2):  # the second time all pieces are known
        assert [x.tolist() for x in coder.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_token_files_round_trip(spark, tmp_path):
    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(4)
    rows = [(rng.randrange(10**9), " ".join(rng.choice(HARD) for _ in range(rng.randrange(0, 40))), "s") for _ in range(300)] + [(5, None, None), (6, "", "s")]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in O.round_trip(frame(spark, rows), TOKENIZER).collect()}
    start = 0
    for i, x, _ in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert O.round_trip(frame(spark, []), TOKENIZER).count() == 0
    O.write_ids(frame(spark, rows), TOKENIZER, f"{tmp_path}/ids")
    some = dict(rows[k][:2] for k in (3, 77, -1))
    one = {r.doc_id: r.ids for r in O.read_documents(spark, f"{tmp_path}/ids", [*some, 123]).collect()}
    assert one == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in some.items()}
    odd = O.round_trip(frame(spark, [(None, "a", "s"), (1, "b", "s"), (1, "c", "s")]), TOKENIZER).collect()
    assert sorted(r.start for r in odd) == [0, 2, 4]


def test_dropping_ids_keeps_null_keys(spark):
    docs = frame(spark, [(1, "a", "s"), (None, "b", "s"), (2, "c", "s")])
    assert sorted(r.text for r in without(docs, spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")).collect()) == ["a", "b"]


def test_pipeline_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    seen = docs
    kept = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, seen, d)
        assert k == 4 or out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in seen.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4]
    # near duplicates: brute force on what the stage read
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    lost = {j for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert kept[0] - kept[1] == lost
    leaks = {r.doc_id for r in B.contaminated_pairs(spark.read.parquet(f"{tmp_path}/1"), spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert kept[1] - kept[2] == leaks
    mixed = {r.doc_id: r.n for r in spark.read.parquet(f"{tmp_path}/3").groupBy("doc_id").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()}
    assert mixed == {r.doc_id: r.taken for r in M.mix(spark.read.parquet(f"{tmp_path}/2")).collect() if r.taken}
    assert spark.read.parquet(f"{tmp_path}/4").count() == spark.read.parquet(f"{tmp_path}/3").count()


def test_stages_drop_rows_and_not_ids(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    benchmark = spark.createDataFrame([(1, c)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(7, a, "s"), (7, a, "s"), (None, a, "s"), (7, b, "s"), (None, b, "s"), (3, a, "s"), (8, None, "s"), (None, None, "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/1")
    for docs in (spark.read.parquet(f"{tmp_path}/1"), frame(spark, rows)):
        got = corpus_pipeline.near_duplicates(spark, docs, f"{tmp_path}")
        assert got.columns == docs.columns and sorted(map(str, ((r.doc_id, (r.text or "-")[0]) for r in got.collect()))) == sorted(map(str, [(3, "a"), (7, "b"), (8, "-"), (None, "-")]))
    frame(spark, [(5, c, "s"), (5, a, "s"), (None, c, "s"), (None, b, "s"), (6, None, "s")]).write.parquet(f"{tmp_path}/2")
    left = corpus_pipeline.leaks(spark, spark.read.parquet(f"{tmp_path}/2"), f"{tmp_path}").collect()
    assert sorted(map(str, ((r.doc_id, (r.text or "-")[0]) for r in left))) == sorted(map(str, [(5, "a"), (None, "b"), (6, "-")]))


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    base = "doc_id long, text string, lang string, source string, n_chars long, row_key string, __size string, component_id string"
    words_ = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [(1, words_(40)), (1, words_(40)), (None, words_(40)), (None, "only here " * 9), (2, None), (3, ""), (4, " \n"), (4, "é " * 30), (5, words_(3000))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for name, some in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "x", "y") for i, t in some], base)
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert set(r.doc_id for r in out) <= {i for i, _ in some} and bool(out) == bool(some)
        assert [r.start for r in sorted(out, key=lambda r: r.start)] == list(itertools.accumulate([0] + [r.n_tokens for r in sorted(out, key=lambda r: r.start)]))[:-1]
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), "")
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted({(str(i), t or "") for i, t in rows if not (i is None and t == rows[0][1])})
    mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), "")
    assert mixed.columns == docs.columns and {r["__size"] for r in mixed.collect()} == {"x"}

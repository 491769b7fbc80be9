"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with the reference of its language in two histograms: kinds of characters, and the language's
commonest words in lower case (all other words are one more bin). References are the sums over all documents of the language that pass the base rules,
made again without those that the first ones reject. The
verdict is on Jensen-Shannon distances (base 2): kinds of characters above `max_char`, or common words above
`max_word`, reject. Guards: below `min_chars` characters in words, or `min_words` words, that histogram has no say;
so it has where the language has no list here or no reference.

Base rules: n_words < 20, or more than 30 % of words in 8-word windows that the text holds twice or more.

Defined results: null and empty texts have zero counts and base_failed true; repeated rows are judged one by one; null doc_ids and extra
columns pass; a null or unknown lang is judged by the base rules alone. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Function words of each language.
COMMON = {
    "en": "the of and to in is that it for on was be with as by this are at from an".split(),
    "de": "der die und das den von ist sich zu mit auf als ein eine nicht im dem des es für".split(),
    "fr": "le la de et les des un une est que pour dans en du par pas qui sur au elle".split(),
    "es": "de la que el en y los del se las por un para con no una su lo es como".split(),
}
BINS = 20
WS = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Characters in words are counted by kind; what none of these matches is a bin of its own.
KINDS = (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r".,;:!?'\"()\-", r"#*$%&|<>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def only(text: Column, kind: str) -> Column:
    """How many characters of the kind text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def covered(hashes: Column, n: int) -> Column:
    """Positions covered by those windows of n words whose hash stands twice or more."""
    def marked(s: Column) -> Column:
        same = lambda i, j: (j >= 0) & (j < F.size(s)) & F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get(s, i)["i"]))
        return let(F.sort_array(F.filter(at, lambda p: p.isNotNull())), lambda p: F.when(F.size(p) == 0, 0).otherwise(
            F.aggregate(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.least(F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(n)), F.lit(n))), F.lit(0), lambda a, x: a + x)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # no hash twice, as in most texts: nothing to sort
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, marked))


def features(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    named = {lang: [F.xxhash64(F.lit(w)) for w in words] for lang, words in COMMON.items()}
    common = reduce(lambda rest, kv: F.when(F.col("lang") == kv[0], F.array(*kv[1])).otherwise(rest), named.items(), F.array().cast("array<bigint>"))
    any_common = [h for words in named.values() for h in words]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", f"[{WS}]+"), lambda w: w != ""))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    windows = F.when(n >= 8, let(F.col("hashes"), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 7), lambda i: F.xxhash64(F.slice(h, i, 8))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WS}]"))
    words = F.concat_ws("", "words")
    counts = let(F.filter("hashes", lambda h: h.isin(*any_common)), lambda found: F.transform("common", lambda c: F.size(F.filter(found, lambda h: h == c))))
    rows = rows.withColumns({"common": common, "windows": windows, "lines": lines, "solid": words})
    rows = rows.withColumn("counts", counts)
    out = rows.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), F.length("solid").cast("long").alias("word_chars"),
        only(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("windows"), 8).cast("long").alias("n_repeat_words"),
        F.array(*(only(F.col("solid"), k).cast("long") for k in KINDS)).alias("kinds"),
        F.coalesce(F.col("counts").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("commons"),
    )
    rest = lambda bins, total: F.concat(bins, F.array(F.col(total) - F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x)))
    out = out.withColumns({"kinds": rest("kinds", "word_chars"), "commons": rest("commons", "n_words")})
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def distance(bins: str, reference: str) -> Column:
    """Jensen-Shannon distance of two histograms of counts."""
    def share(c: str) -> Column:
        return let(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).cast("double"), lambda n: F.transform(c, lambda x: x / n))

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.zip_with(share(bins), share(reference), lambda p, q: term(p, q) + term(q, p))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def measured(rows: DataFrame, pool: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """rows with their distances from the sums of pool; null where a guard holds. The reference has a row a listed language, so four at most."""
    total = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n)))
    reference = pool.where(F.col("lang").isin(*COMMON)).groupBy(F.col("lang").alias("of")).agg(total("kinds", len(KINDS) + 1).alias("all_kinds"), total("commons", BINS + 1).alias("all_commons"))
    both = rows.join(F.broadcast(reference), F.col("lang") == F.col("of"), "left")
    there = F.col("of").isNotNull()
    char = F.when(there & (F.col("word_chars") >= min_chars), distance("kinds", "all_kinds"))
    word = F.when(there & (F.col("n_words") >= min_words), distance("commons", "all_commons"))
    return both.withColumns({"char_distance": char, "word_distance": word}).drop("of", "all_kinds", "all_commons")


def judge(docs: DataFrame, max_char: float = 0.2, max_word: float = 0.33, min_chars: int = 100, min_words: int = 60) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    rows = stage(features(docs), "features")
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    passed = rows.where(~F.col("base_failed"))
    # the reference is made twice: the second time without what the first one rejects
    typical = measured(passed, passed, min_chars, min_words).where(near)
    out = measured(rows, typical, min_chars, min_words)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")

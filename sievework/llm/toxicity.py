"""Toxicity: a lexicon met by Levenshtein automata, and scores of the context in which its terms stand.

The lexicon has a fixed part (terms of abuse in English) and one learned from labelled documents: words and word beginnings (stems) that stand far more
often in documents labelled toxic. Every distinct word of a text runs through the automaton (levenshtein.Lexicon), so misspelled terms are met as well, also
those with digits or signs among their letters ('1diot', 'st*pid'). Words frequent in non-toxic documents are never taken for misspelled terms, and a learned
term allows only as many errors as leave all of them out. A misspelled hit counts in the same sums as an exact one, divided by one more than its errors.
Each hit is weighed by its context, `WINDOW` words to either side: more hits and words of address raise it, quotation
marks around it and words of report lower it. A logistic regression on these sums, fitted on labelled documents, gives the score.

Labels are taken only from rows with crc32(doc_id as text) mod 3 <> 1, at most `max_labelled` of them (least hash first);
doc_id, lang and source are never inputs. Their words are counted, and their features taken, in tasks; no text comes to the driver. Scoring is one scan without a shuffle.

Defined results: null and empty texts get the score of a text without hits; repeated rows are scored one by one; a null doc_id is not held
out; extra columns are not read. Without toxic labels to learn from, fixed coefficients are used.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, stage, text_rows, unstage
from .levenshtein import Lexicon

# English terms of abuse.
TERMS = """idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown imbecile cretin
jerk creep freak vermin filth filthy retard bastard bitch asshole dickhead bullshit shithead fuck fucking fucker motherfucker whore slut cunt wanker twat
prick dumbass jackass scumbag lowlife degenerate subhuman parasite braindead halfwit dimwit nitwit simpleton bonehead""".split()
# Words of report, and words of address.
REPORT = frozenset("said says wrote writes quoted quote called calls word words term insult insults slur slurs dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're youre u are is such these those all they du dich ihr sie tu vous toi vosotros ustedes eres".split())
OPEN = "\"'“”‘’«»„"
WINDOW = 8
#: What may stand for a letter, and what for any letter.
LEET = str.maketrans("01345789@$€!|+", "oieastbgaseiit")
SIGNS = "*#"
#: Runs of letters that hold digits or signs.
MASKED = re.compile(r"(?<![\w*#@$€!|+])[^\W\d_]*+[\d_*#@$€!|+][\w*#@$€!|+]*+")
#: Words that are one or two errors away from a fixed term and no abuse, whether or not labelled documents have them.
PLAIN = frozenset("""idiom idioms boron baron maroon macron moran stupor lower lowers lose loses lover lovers closer closers poser posers laser lasers leser loner loners crash brash thrash
crown crowns down blown brown jerky creed creek creeks crepe break breaks freaky filthy bitch batch pitch witch ditch hitch botch where whole chore shore wore store prick
price brick trick pick pricy cycle ducking sucking tucking bucking locking tucker sucker pucker garage switch buster bustard custard mustard dastard parasitic degenerated
degenerative distrusting digesting discussing discusting worth wordless wireless empathetic apathetic sympathetic pathetically vermeil venison verity cretan creation
certain halfway""".split())
#: The weight of fixed terms, and the greatest of learned ones.
SURE, LEARNED = 4.5, 4.0
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Used where nothing can be learned: intercept, then a weight for each of summary()'s numbers.
PRIOR = np.array([-4.0, 1.2, 2.0, 1.0, 0.5, -2.0, 0.0])
#: Non-toxic documents that a word stands in to be frequent.
FREQUENT = 3
#: Distinct words that a task remembers; then it forgets all and goes on.
KNOWN = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a star."""
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def words_of(text: bytes) -> set[str]:
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def unmasked(self, word: str) -> tuple[float, int] | None:
        """Weight and errors of the term that a word with digits or signs stands for; what they hide is one error, stems don't count."""
        plain = word.translate(LEET)
        spelled = [plain.replace(x, c) for x in SIGNS if plain.count(x) == 1 for c in "abcdefghijklmnopqrstuvwxyz"] if sum(map(plain.count, SIGNS)) == 1 else [plain]
        found = [f for f in (self.lexicon.match(w, stems=False) for w in spelled) if f and f[1] == 0]
        return (max(found)[0], 1) if found else self.lexicon.match(word, stems=False)

    def words(self, low: str) -> list[tuple[int, str]]:
        """Words and where they begin. A run with digits or signs inside is one word if it is a hit, else its letters are words."""
        out = [(m.start(), m[0]) for m in WORD.finditer(low)]
        masked = []
        for m in MASKED.finditer(low):
            word = m[0].rstrip("*#!|+_").lstrip("*#!|+_")
            if len(word) > 24 or sum(c.isalpha() for c in word) < 2 or word.isalpha():
                continue
            if word not in self.known:
                self.known.add(word)
                found = self.unmasked(word)
                if found:
                    self.hits[word] = found
            if word in self.hits:
                at = m.start() + m[0].index(word)
                masked.append((at, at + len(word), word))
        if masked:
            begins = [a for a, _, _ in masked]
            out = [(i, w) for i, w in out if (k := bisect_right(begins, i)) == 0 or i >= masked[k - 1][1]]
            out = sorted(out + [(a, w) for a, _, w in masked])
        return out

    def summary(self, text: bytes) -> np.ndarray:
        """Hits (log), their weight in context (log), that of the strongest, hits per 100 words (log), share in quotation, weight of misspelled hits (log).

        A misspelled hit counts in part in all of them; the last number is for what labels say of misspelled hits beyond that.
        """
        low = text.decode("utf-8", "replace").lower()
        placed = self.words(low)
        words = [w for _, w in placed]
        distinct = set(words)
        for w in distinct - self.known:
            found = self.lexicon.match(w)
            if found:
                self.hits[w] = found
        self.known |= distinct
        there = distinct & self.hits.keys()
        if len(self.known) > KNOWN:
            hits = {w: self.hits[w] for w in there}
            self.known, self.hits = set(there), hits
        if not there:
            return np.zeros(6)
        at = [i for i, w in enumerate(words) if w in there]
        spots = [i for i, _ in placed] if any(q in low for q in OPEN) else None
        near = set(at)
        n = total = strongest = quoted = wrong = 0.0
        for i in at:
            weight, errors = self.hits[words[i]]
            around = range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))
            context = 1.0 + 0.25 * min(3, sum(j in near for j in around) - 1) + 0.25 * any(words[j] in ADDRESS for j in around if abs(j - i) <= 3)
            report = any(words[j] in REPORT for j in around)
            marked = False
            if spots:
                before, after = low[max(0, spots[i] - 1) : spots[i]], low[spots[i] + len(words[i]) :][:1]
                marked = before != "" and before in OPEN or after != "" and after in OPEN
            quote = 0.5 * report + 0.5 * marked
            quoted += quote
            weight = weight * context * (1 - 0.6 * quote) / (1 + errors)
            n += 1 / (1 + errors)
            total += weight
            wrong += weight if errors else 0.0
            strongest = max(strongest, weight)
        return np.array([np.log1p(n), np.log1p(total), strongest / 4, np.log1p(100 * n / len(words)), quoted / len(at), np.log1p(wrong)])


def score(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model[0] + x @ model[1:], -60, 60)))


#: Grams that a task counts before it passes them on.
HELD = 300_000
GRAM = "gram string, bad0 long, bad1 long, good0 long, good1 long"


def gram_counts(sample: DataFrame) -> DataFrame:
    """In how many documents of each half (`half`) each word or starred beginning stands: toxic ones (bad) and others (good). Added up in tasks first."""
    schema = pa.schema([("gram", pa.string()), *((c, pa.int64()) for c in ("bad0", "bad1", "good0", "good1"))])

    def flush(held):
        return batch(schema, list(held), *([v[k] for v in held.values()] for k in range(4)))

    def count(batches):
        held: dict[str, list[int]] = {}
        for b in batches:
            for toxic, half, t in zip(*(b.column(c).to_pylist() for c in ("toxic", "half", "text"))):
                for g in grams(words_of(t)):
                    held.setdefault(g, [0, 0, 0, 0])[2 * (not toxic) + half] += 1
            if len(held) > HELD:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return map_arrow(sample.select("toxic", "half", "text"), count, GRAM).groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("bad0", "bad1", "good0", "good1")))


def learned(counts: DataFrame, bad: Column, good: Column, n_bad: int, n_good: int, least: int = 4, odds: float = 3.0) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose share of toxic documents is exp(odds) times that of the others, or more; weights are log odds, LEARNED at most."""
    value = F.log((bad + 0.5) / F.lit(n_bad + 1)) - F.log((good + 0.5) / F.lit(n_good + 1))
    # the lower end of what chance allows, so that rare words need more evidence
    value = value - 1 / F.sqrt(bad) - 0.5 / F.sqrt(good + 1)
    found = counts.where(bad >= least).select("gram", F.least(value, F.lit(LEARNED)).alias("weight")).where(F.col("weight") >= odds).collect()
    terms = {r.gram: r.weight for r in found if not r.gram.endswith("*")}
    return terms, {r.gram[:-1]: r.weight for r in found if r.gram.endswith("*")}


def lexicon_of(terms: dict[str, float], stems: dict[str, float], counts: DataFrame, good: Column) -> Lexicon:
    """Fixed and learned terms; a learned one allows as many errors as keep it away from words frequent in non-toxic documents. The words run
    through the automaton where they are; only those near a term come to the driver."""
    base = {t: SURE for t in TERMS}
    every = terms | base
    trial = Lexicon(every, {})
    schema = pa.schema([("word", pa.string()), ("term", pa.string()), ("errors", pa.int64())])

    def near(batches):
        for b in batches:
            rows = [(w, *hit) for w in b.column("gram").to_pylist() if w not in every for hit in trial.near(w)]
            if rows:
                yield batch(schema, *map(list, zip(*rows)))

    words = counts.where((good >= FREQUENT) & ~F.endswith("gram", F.lit("*"))).select("gram")
    found = [tuple(r) for r in map_arrow(words, near, "word string, term string, errors long").collect()]
    found += [(w, *hit) for w in sorted(PLAIN - every.keys()) for hit in trial.near(w)]
    budgets: dict[str, int] = {}
    for _, term, errors in found:
        if term not in base:
            budgets[term] = min(budgets.get(term, errors), errors - 1)
    return Lexicon(every, stems, budgets=budgets, plain=frozenset(w for w, *_ in found))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    a = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), l2 * len(x))
    ridge[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def features(rows: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """The columns kept of rows, and `x`, the summary of their text."""
    kept = rows.select(*keep)
    names, schema = kept.columns, pa.schema([("x", pa.list_(pa.float64()))])

    def summaries(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            x = pa.array([scorer.summary(t).tolist() for t in b.column("text").to_pylist()], schema[0].type)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), x], names=[*names, "x"])

    return map_arrow(rows.select(*keep, "text"), summaries, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and coefficients from at most max_labelled labelled texts (least hash first), each text of a doc_id once. Words are counted and features are
    taken in tasks; the driver gets the terms found and six numbers a text, whatever the texts' sizes."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = text_rows(docs, "doc_id").join(F.broadcast(picked), "doc_id").withColumn("t", F.xxhash64("text"))
    fits = rows.select("doc_id", "t").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(max_labelled)
    sample = rows.join(F.broadcast(fits), ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = stage(sample.withColumn("half", F.pmod(F.xxhash64("t", "doc_id"), F.lit(2)).cast("int")), "labelled")
    n = {(r.half, r.toxic): r.n for r in sample.groupBy("half", F.col("toxic").cast("boolean").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = ([n.get((h, y), 0) for y in (True, False)] for h in (0, 1))
    counts = stage(gram_counts(sample), "grams")
    # terms are learned on one half and coefficients on the other, then terms on all
    model = PRIOR
    if n1[0] >= 3 and n1[1]:
        terms, stems = learned(counts, F.col("bad0"), F.col("good0"), *n0)
        seen = features(sample.where("half = 1"), lexicon_of(terms, stems, counts, F.col("good0")), "doc_id", "t", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("t", "ascending")])
        x, y = np.array(seen["x"].to_pylist()), seen["toxic"].to_numpy().astype(float)
        model = fit(x, y)
        if model[-1] < 0:  # labels may hold too few misspelled terms to tell; they never speak for a text
            model = np.append(fit(x[:, :-1], y), 0.0)
    bad, good = F.col("bad0") + F.col("bad1"), F.col("good0") + F.col("good1")
    terms, stems = learned(counts, bad, good, n0[0] + n1[0], n0[1] + n1[1])
    lexicon = lexicon_of(terms, stems, counts, good)
    unstage(sample, counts)
    return lexicon, model


def score_documents(docs: DataFrame, lexicon: Lexicon, model: np.ndarray, at: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def rows(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            x = np.array([scorer.summary(t) for t in b.column("text").to_pylist()]).reshape(-1, 6)
            s = score(x, model)
            yield batch(schema, b.column("doc_id"), b.column("held_out"), s, (s >= at).astype(np.int32))

    text = text_rows(docs, F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return map_arrow(text, rows, "doc_id long, held_out boolean, score double, predicted int")

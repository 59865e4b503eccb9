"""Toxicity: misspelled lexicon terms by Levenshtein automata on a trie, and context windows.

Method. A lexicon of terms (whole words, and stems that open many words) is learned from labelled rows or
given. It becomes a trie; for each word of a text a Levenshtein automaton of that word (its states are rows of
the edit table) is run down the trie, so that only branches within the allowed distance are visited. Each hit is
seen in a window of words: quotation marks and words of reporting count towards quotation, words that
address a reader count towards abuse. A logistic model over these counts, fitted on the labelled rows, is the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ._common import unused

#: Most labelled rows that a fit reads (the rows with the least hash of their id).
TRAIN_ROWS = 20_000
#: Terms need this many distinct toxic training texts, and this share of the texts that hold them toxic.
MIN_ROWS, MIN_SHARE = 5, 0.85
#: A stem is dropped if one word (or, at 0.95, one longer stem) has this share of its rows.
STEM_SHARE = 0.8
STEM_LENGTHS = (4, 5, 6)
#: Words each side of a hit.
WINDOW = 6
CACHE_WORDS = 250_000

# Quotation marks, words of reporting, words of address.
QUOTES = "\"'“”„«»‘’"
REPORTING = frozenset("said says wrote writes called quoted quote quoting according slur term word dit écrit selon mot citation sagte schrieb laut wort zitat dijo escribió según palabra cita".split())
ADDRESS = frozenset("you your you're u ur tu toi vous votre ton du dich dein ihr euch usted ustedes eres".split())

WORD = re.compile(r"[^\W\d_]+")
#: Letters with digits and marks among them, as in disguised spellings.
MIXED = re.compile(r"\w(?:[\w@$!*'’.-]*\w)?")
#: Longer runs are looked up each time, not cached.
CACHE_LENGTH = 64
FEATURES = ["hits", "fuzzy", "weight", "top", "rate", "quoted", "reported", "addressed"]

Term = tuple[str, float, bool]  # term, weight, whether it is a stem


class Trie:
    """Terms as nested dicts; a term's end holds (weight, is_stem) under the empty string."""

    def __init__(self, terms: list[Term]):
        self.root: dict = {}
        for term, weight, stem in terms:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = (weight, stem)

    @staticmethod
    def allowed(n: int) -> int:
        """Edits allowed for a word of n letters: none below 5, one below 9, else two."""
        return 0 if n < 5 else 1 if n < 9 else 2

    def find(self, word: str) -> float | None:
        """The weight of the heaviest term that is the word, or a stem that opens it; None if there is none."""
        node, best = self.root, None
        for ch in word:
            node = node.get(ch)
            if node is None:
                return best
            if "" in node and node[""][1]:
                best = node[""][0] if best is None else max(best, node[""][0])
        if "" in node:
            best = node[""][0] if best is None else max(best, node[""][0])
        return best

    def nearest(self, word: str, most: int) -> tuple[float, int] | None:
        """(weight, edits) of the nearest term within ``most`` edits, heavier terms first; None if there is none."""
        # the automaton's state after a trie prefix is the row of edit distances to each prefix of the word
        found, n = None, len(word)
        stack = [(self.root, [*range(n + 1)])]
        while stack:
            node, row = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    continue
                new = [row[0] + 1]
                low = new[0]
                for i in range(1, n + 1):
                    d = row[i - 1] if word[i - 1] == ch else 1 + min(row[i - 1], row[i], new[i - 1])
                    new.append(d)
                    if d < low:
                        low = d
                if low > most:
                    continue
                if "" in child and new[n] <= most:
                    key = (-new[n], child[""][0])
                    found = max(found or key, key)
                stack.append((child, new))
        return (found[1], -found[0]) if found else None


def _without(word: str, most: int) -> set[str]:
    """The word and what is left of it after up to ``most`` (1 or 2) letters are taken out."""
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    if most > 1:
        one.update([word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(len(word)) for j in range(i + 1, len(word))])
    one.add(word)
    return one


class Near:
    """Which words can be within the allowed edits of a term.

    Two tests, each of which loses nothing. Of a term cut into k + 1 parts k edits leave one as it is, at most k places
    away: few words hold such a part there. And a word within k edits of a term can be made equal to it by taking at most k
    letters out of each, so what is left of the word must be among what is left of the terms. The cost for a word does not
    grow with the terms. Words longer than ``LONG`` have the first test only.
    """

    LONG = 24

    def __init__(self, terms: list[str]):
        self.left: dict[int, set[str]] = {k: set().union(*(_without(t, k) for t in terms if len(t) <= self.LONG + 2)) for k in (1, 2)}
        #: For each length of a word: (place, length of a part, parts that may stand there).
        self.parts: dict[int, list[tuple[int, int, frozenset[str]]]] = {}
        found: dict[int, dict[tuple[int, int], set[str]]] = {}
        for t in terms:
            for n in range(max(1, len(t) - 2), len(t) + 3):
                k = Trie.allowed(n)
                if k == 0 or abs(len(t) - n) > k:
                    continue
                cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    for at in range(max(0, a - k), a + k + 1):
                        found.setdefault(n, {}).setdefault((at, b - a), set()).add(t[a:b])
        self.parts = {n: [(at, at + size, frozenset(p)) for (at, size), p in own.items()] for n, own in found.items()}

    def may(self, word: str, edits: int) -> bool:
        """Whether a word may be within ``edits``, those that are allowed for its length, of a term."""
        own = self.parts.get(len(word))
        if own is None:
            return False
        for a, b, parts in own:
            if word[a:b] in parts:
                return len(word) > self.LONG or not self.left[edits].isdisjoint(_without(word, edits))
        return False


class Scorer:
    """Counts of hits and of their contexts for whole texts, with a bounded cache of words."""

    def __init__(self, terms: list[Term]):
        self.exact = Trie(terms)
        # words that may have edits have 5 letters or more, so terms below 4 are out of reach
        self.lexicon = Trie(whole := [t for t in terms if not t[2] and len(t[0]) > 3])
        self.near = Near([t[0] for t in whole])
        self.cache: dict[str, tuple[float, int] | None] = {}
        self.runs: dict[str, tuple[float, int] | None] = {}

    def edited(self, word: str) -> tuple[float, int] | None:
        k = Trie.allowed(len(word))
        return self.lexicon.nearest(word, k) if k and self.near.may(word, k) else None

    def look(self, word: str) -> tuple[float, int] | None:
        if word in self.cache:
            return self.cache[word]
        got = self.exact.find(word)
        got = self.edited(word) if got is None else (got, 0)
        self.cache[word] = got
        return got

    def look_run(self, run: str) -> tuple[float, int] | None:
        """What a run of letters, digits and marks stands for as a whole; None if one of its words is a hit by itself."""
        if run in self.runs:
            return self.runs[run]
        parts, got = WORD.findall(run), None
        if parts and not any(map(self.look, parts)):
            bare = self.exact.find("".join(parts)) if len(parts) > 1 else None
            got = self.edited(run) if bare is None else (bare, 1)
        if len(run) <= CACHE_LENGTH:
            self.runs[run] = got
        return got

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        if len(self.cache) + len(self.runs) > CACHE_WORDS:
            self.cache.clear()
            self.runs.clear()
        low = text.lower()
        letters = set(WORD.findall(low))
        found = {w: got for w in letters if (got := self.look(w))}
        found |= {r: got for r in set(MIXED.findall(low)) - letters if (got := self.look_run(r))}
        if not found:
            return [0.0] * len(FEATURES)
        words = []
        if letters.issuperset(found):
            words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        else:
            for r in MIXED.finditer(low):
                if r.group() in found:
                    words.append((r.group(), r.start(), r.end()))
                else:
                    words.extend((m.group(), m.start(), m.end()) for m in WORD.finditer(low, r.start(), r.end()))
        hits = fuzzy = quoted = reported = addressed = 0
        weight, top = 0.0, 0.0
        for i, (w, a, b) in enumerate(words):
            if w in found:
                gain, edits = found[w]
                fuzzy += edits > 0
                hits += 1 / (1 + edits)
                weight += gain / (1 + edits)
                top = max(top, gain / (1 + edits))
                first, last = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
                left, right = low[words[first][1] : a], low[b : words[last - 1][2] + 1]
                near = {x for x, _, _ in words[first:last]}
                quoted += any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
                reported += not near.isdisjoint(REPORTING)
                addressed += not near.isdisjoint(ADDRESS)
        n = sum(w in found for w, _, _ in words)
        return [math.log1p(hits), math.log1p(fuzzy), math.log1p(weight), top, hits / len(words), quoted / n, reported / n, addressed / n]


_scorers: dict[int, Scorer] = {}


def _scorer(terms) -> Scorer:
    key = hash(tuple(terms))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(terms)
    return _scorers[key]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents, those with the least hash of their id.

    The label side is bounded by ``rows`` and so may be broadcast. Null ids and labels other than 0 and 1 are left out; of
    repeated ids with unequal labels the larger label counts, and of documents that share an id the least text.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    if usable is not None:
        chosen = chosen.where(usable)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # ids alone tell whether any is shared; texts are only shuffled if so
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own
    return own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def learn_lexicon(train: DataFrame) -> list[Term]:
    """(term, weight, is_stem) from rows of (text, y): words and stems that toxic rows have far more often.

    Document frequencies are counted in Spark over the distinct words of distinct texts, so that copies of a text count
    once (with the larger label); all terms that pass ``MIN_ROWS`` and ``MIN_SHARE`` come to the driver. Each
    stands for ``MIN_ROWS`` of at most ``TRAIN_ROWS`` texts.
    """
    words = F.array_distinct(F.expr(r"filter(split(lower(text), '(?U)[^\\p{L}]+'), w -> w <> '')"))
    texts = train.where("text IS NOT NULL").groupBy("text").agg(F.max("y").alias("y"))
    pool = texts.select("y", words.alias("w"))

    def stems(n: int) -> Column:
        return F.transform(F.array_distinct(F.expr(f"transform(filter(w, x -> length(x) >= {n}), x -> substring(x, 1, {n}))")), lambda x: F.struct(x.alias("term"), F.lit(True).alias("stem")))

    forms = F.concat(F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(False).alias("stem"))), *map(stems, STEM_LENGTHS))
    counts = pool.select("y", F.explode(forms).alias("f")).groupBy("f").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    total = texts.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    bad, good = total["bad"] or 0, (total["n"] or 0) - (total["bad"] or 0)
    kept = counts.where(F.col("bad") >= MIN_ROWS).where(F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("good") * ((bad + 1.0) / (good + 1.0))))
    # a stem or word must also be right about the rows as they are
    kept = kept.where(F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("good")))
    rows = kept.select("f.term", "f.stem", "bad", "good").collect()
    found = [(r["term"], r["stem"], r["bad"], math.log((r["bad"] + 1) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1))) for r in rows]
    behind: dict[str, int] = {}  # the rows of the most frequent word or longer stem behind each stem
    for t, stem, n, _ in found:
        for k in range(min(STEM_LENGTHS), len(t) if stem else len(t) + 1):
            behind[t[:k]] = max(behind.get(t[:k], 0), n if not stem else int(n / 0.95 * STEM_SHARE))
    stems: dict[str, float] = {}
    for t, stem, n, w in sorted(found, key=lambda x: len(x[0])):
        # a stem stands for many words, not for one; longer stems must say more than shorter ones
        if stem and behind.get(t, 0) < STEM_SHARE * n and all(stems.get(t[:k], -math.inf) < w for k in STEM_LENGTHS if k < len(t)):
            stems[t] = w
    # words behind a stem are found by it, but must be known to be sought with edits
    opens = [F.substring("x", 1, k).isin([t for t in stems if len(t) == k]) for k in STEM_LENGTHS if any(len(t) == k for t in stems)]
    whole = {t: w for t, stem, _, w in found if not stem}
    if opens:
        seen = pool.where("y = 1").select(F.explode("w").alias("x")).where(reduce(or_, opens)).distinct().collect()
        for (x,) in seen:
            whole[x] = max(whole.get(x, -math.inf), *(stems[x[:k]] for k in STEM_LENGTHS if x[:k] in stems))
    rank = {(t, stem): -n for t, stem, n, _ in found}
    terms = [*((t, w, True) for t, w in stems.items()), *((t, w, False) for t, w in whole.items())]
    return sorted(terms, key=lambda t: (rank.get((t[0], t[2]), 0), -t[1], t[0]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights with the intercept first, by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(docs: DataFrame, terms: list[Term], *keep: str, name: str = "f") -> DataFrame:
    """Columns ``keep`` of docs and ``name``, the array of ``FEATURES`` of each text."""
    # as one struct, so that names of any kind pass
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(terms)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                row, texts = b.slice(i, 512).columns
                f = pa.array([scorer.features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([row, f], names=["__row", name])

    schema = StructType([rows.schema["__row"], StructField(name, ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema).select("__row.*", name)


class ToxicityModel:
    """A learned lexicon and weights; ``score`` judges any documents."""

    def __init__(self, terms: list[Term], weights: list[float]):
        self.terms, self.weights = terms, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> ToxicityModel:
        """From documents (doc_id, text) and labels (doc_id, toxic); ``usable`` picks rows by doc_id.

        With no labelled rows, or labels of one kind only, every text scores the share of toxic labels (0 if none).
        """
        train = training_rows(docs, labels, "toxic", usable)
        terms = learn_lexicon(train)
        got = features(train, terms, "y").collect()  # TRAIN_ROWS rows at most
        y = np.array([r["y"] for r in got], dtype=float)
        if len(y) == 0 or y.min() == y.max():
            rate = float(y.mean()) if len(y) else 0.0
            return cls(terms, [30.0 * (2 * rate - 1), *[0.0] * len(FEATURES)])
        return cls(terms, _logistic(np.array([r["f"] for r in got]), y).tolist())

    def score(self, docs: DataFrame, *keep: str, name: str = "score") -> DataFrame:
        """Columns ``keep`` of docs and ``name``, the score (0 to 1; null and empty texts score as texts without hits).

        ``keep`` may hold names of any kind but ``name``.
        """
        w, f = self.weights, unused("f", keep)
        z = sum((F.lit(v) * F.col(f)[i] for i, v in enumerate(w[1:])), F.lit(w[0]))
        return features(docs, self.terms, *keep, name=f).select(*[F.col(f"`{c}`") for c in keep], (1 / (1 + F.exp(-z))).alias(name))


def held_out(remainder: int, mod: int, *, equal: bool) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder`` mod ``mod`` (or does not)."""
    r = F.crc32(F.col("doc_id").cast("string")) % mod
    return r == remainder if equal else r != remainder


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document, fitted on the labelled rows not held out.

    Null or empty text: the score of a text without hits. Null doc_id: scored; held_out is null. Repeated rows are
    scored each. Very long texts are read whole. Empty tables give empty results. Other columns are not read.
    """
    model = ToxicityModel.fit(docs, labels, held_out(0, 5, equal=False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return model.score(rows, "doc_id").select("doc_id", held_out(0, 5, equal=True).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

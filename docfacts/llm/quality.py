"""Document quality: a sparse ensemble of rules over text statistics, compiled into Spark columns.

Method. Statistics of a text are Spark expressions. Random-forest trees are grown on labelled rows; each path
from a root is a conjunction of comparisons, that is a rule. A logistic model with an L1 penalty (lasso) over
the rules keeps few of them. The kept rules become one Spark column, so scoring is a plain projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import training_rows

#: Most labelled rows that a fit reads (the rows with the least hash of their id).
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002

#: Characters whose counts are statistics, with the name of each.
MARKS = {"bang": "!", "dollar": "$", "percent": "%", "amp": "&", "hash": "#", "star": "*", "pipe": "|"}
#: Prefixed, so that they do not clash with columns of the documents.
STATS = [f"__stat_{x}" for x in ("n_chars", "n_words", "distinct_share", "word_length", "repeat_share", "capital_share", "mark_share", *(f"{k}_share" for k in MARKS))]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and one double column for each of ``STATS``; a null text counts as empty.

    Shares are per word (marks, repeats of the word before) or per character (capitals A-Z).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in keep]
    a = docs.select(*keep, text.alias("__stat_t"), F.split(F.trim(F.translate(text, "\n\t", "  ")), " ", -1).alias("__stat_w"))
    t, w = F.col("__stat_t"), F.col("__stat_w")
    count = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    # a word equal to the one before it counts as a repeat
    repeat = F.aggregate(w, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + (x == s["last"]).cast("int")).alias("n")), lambda s: s["n"])
    sums = F.struct(
        F.length(t).cast("double").alias("chars"),
        F.size(w).cast("double").alias("words"),
        F.size(F.array_distinct(w)).cast("double").alias("distinct"),
        repeat.cast("double").alias("repeats"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("double").alias("capitals"),
        *(count(c).alias(k) for k, c in MARKS.items()),
    )
    s = a.select(*keep, sums.alias("__stat"))
    of = lambda c: F.col(f"__stat.{c}")
    per_word = lambda c: of(c) / of("words")
    marks = reduce(lambda x, y: x + y, (of(k) for k in MARKS)) / of("words")
    values = [of("chars"), of("words"), per_word("distinct"), per_word("chars"), per_word("repeats"), of("capitals") / F.greatest(of("chars"), F.lit(1.0)), marks, *map(per_word, MARKS)]
    return s.select(*keep, *(v.alias(name) for v, name in zip(values, STATS, strict=True)))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, whether it must be at most the bound, bound) for each comparison."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda x, y: x & y, (F.col(s) <= b if low else F.col(s) > b for s, low, b in self.parts))


def tree_rules(model) -> list[Rule]:
    """The distinct paths from the root to every node below it, of each tree of a fitted forest."""
    found: dict[Rule, None] = {}
    for tree in model.trees:
        stack = [(tree._call_java("rootNode"), ())]
        while stack:
            node, parts = stack.pop()
            if parts:
                found[Rule(parts)] = None
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                name, bound = STATS[split.featureIndex()], float(split.threshold())
                stack.append((node.leftChild(), _and(parts, (name, True, bound))))
                stack.append((node.rightChild(), _and(parts, (name, False, bound))))
    return list(found)


def _and(parts: tuple, new: tuple[str, bool, float]) -> tuple:
    """Adds a comparison; of two bounds on one side of a statistic the tighter stays."""
    same = [p for p in parts if p[:2] == new[:2]]
    if same:
        bound = min(same[0][2], new[2]) if new[1] else max(same[0][2], new[2])
        return tuple(sorted([*(p for p in parts if p[:2] != new[:2]), (new[0], new[1], bound)]))
    return tuple(sorted([*parts, new]))


class QualityModel:
    """Kept rules with their weights; ``column`` is the score over columns of ``statistics``."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> QualityModel:
        """From documents (doc_id, text) and labels (doc_id, quality); ``usable`` picks rows by doc_id.

        With no labelled rows, or labels of one kind only, every text scores that label (one half if there are none).
        """
        train = statistics(training_rows(docs, labels, "quality", usable, rows), "y").persist()
        try:
            kinds = {r["y"] for r in train.select("y").distinct().collect()}
            if len(kinds) < 2:
                return cls([], {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(kinds)])
            vectors = VectorAssembler(inputCols=STATS, outputCol="x").transform(train)
            forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, subsamplingRate=0.7, featureSubsetStrategy="0.6").fit(vectors)
            rules = tree_rules(forest)
            fired = train.select("y", *(r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
            fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(fired).select("x", "y")
            lasso = LogisticRegression(featuresCol="x", labelCol="y", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60).fit(fired)
            return cls([(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist(), strict=True) if w], lasso.intercept)
        finally:
            train.unpersist()

    def column(self) -> Column:
        z = reduce(lambda x, y: x + y, (F.when(r.column(), w).otherwise(0.0) for r, w in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))

    def score(self, docs: DataFrame, *keep: str, name: str = "score") -> DataFrame:
        """Columns ``keep`` of docs and ``name``, the score; ``keep`` may hold names of any kind but ``name``."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
        return statistics(rows, "row").select("row.*", self.column().alias(name))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document, fitted on the labelled rows not held out.

    Null or empty text: statistics of an empty text. Null doc_id: scored; held_out is null. Repeated rows are scored
    each. Very long texts are read whole. Empty tables give empty results. Other columns are not read.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = QualityModel.fit(docs, labels, rest != 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return model.score(rows, "doc_id").select("doc_id", (rest == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

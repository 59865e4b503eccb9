"""Scoring of extracted facts against gold labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import scores

#: Fields that the headline scores count.
KEY_FIELDS = ("discount_rate", "terminal_growth", "exit_multiple")


#: Values that differ by no more are equal.
NEAR = 1e-9


class Free:
    """Predictions of one field and nearly one value, in the order of their ids, that are still free.

    A tree over this order holds the least start and the greatest end below each node, so the first free one whose span overlaps
    is found by going down from the root, past what cannot overlap. A taken one is lifted out of its nodes.
    """

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.size = 1 << max(0, len(rows) - 1).bit_length()
        pad = self.size - len(rows)
        self.low = [math.inf] * self.size + [r[-2] for r in rows] + [math.inf] * pad
        self.high = [-math.inf] * self.size + [r[-1] for r in rows] + [-math.inf] * pad
        for i in range(self.size - 1, 0, -1):
            self._lift(i)

    def _lift(self, i: int) -> None:
        self.low[i], self.high[i] = min(self.low[2 * i : 2 * i + 2]), max(self.high[2 * i : 2 * i + 2])

    def first(self, start: float, end: float, fits) -> int:
        """Place of the first free row whose span overlaps [start, end) and that ``fits``, or -1."""
        open_ = [1]
        while open_:
            i = open_.pop()
            if self.low[i] < end and start < self.high[i]:
                if i < self.size:
                    open_ += (2 * i + 1, 2 * i)
                elif fits(self.rows[i - self.size]):
                    return i - self.size
        return -1

    def take(self, place: int) -> tuple:
        i = self.size + place
        self.low[i], self.high[i] = math.inf, -math.inf
        while i > 1:
            i //= 2
            self._lift(i)
        return self.rows[place]


def greedy(gold: list[tuple], predicted: list[tuple]) -> list[tuple]:
    """(field, gold id, predicted id) of one document: rows are (id, field, low, high, start, end), each side in the order of its ids.

    Values are looked up in cells of twice ``NEAR`` and their neighbours, so nearly equal ones meet wherever cells end.
    """
    cell = lambda v: math.floor(v / (2 * NEAR)) if math.isfinite(v) else v
    of: dict[tuple, list[tuple]] = {}
    for r in predicted:
        of.setdefault((r[1], cell(r[2]), cell(r[3])), []).append(r)
    free = {k: Free(rows) for k, rows in of.items()}
    out, taken = [], set()
    for i, field, low, high, start, end in gold:
        if field == "offer_price":
            start, end = -math.inf, math.inf
        fits = lambda r, low=low, high=high: (r[2] == low or abs(r[2] - low) <= NEAR) and (r[3] == high or abs(r[3] - high) <= NEAR)
        best = None
        a, b = cell(low), cell(high)
        for x in {a - 1, a, a + 1}:
            for y in {b - 1, b, b + 1}:
                own = free.get((field, x, y))
                at = own.first(start, end, fits) if own else -1
                if at >= 0 and (best is None or own.rows[at][0] < best[0].rows[best[1]][0]):
                    best = own, at
        found = best[0].take(best[1])[0] if best else None
        taken.add(found)
        out.append((field, i, found))
    return out + [(r[1], None, r[0]) for r in predicted if r[0] not in taken]


def match(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(accession, field, gold_id, predicted_id): one-to-one matches, and unmatched rows of either side with a null partner.

    Both sides: accession, field, low, high, span_start, span_end and gold_id or predicted_id (their order, unique within a document).
    Gold rows are served in order; each takes the first free prediction whose values are within ``NEAR`` and whose span overlaps
    (offer prices: any span). A null or NaN value, and a null bound outside offer prices, match nothing. A group is one document, so a frequent field or value is not one
    group; in it a lookup takes logarithmic time, also where a document has very many equal values.
    """
    side = lambda df, own, n: df.select("accession", "field", "low", "high", F.lit(n).alias("side"), F.col(own).alias("id"), "span_start", "span_end")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sides: tuple[list, list] = [], []
        for low, high, n, i, field, start, end in zip(pdf["low"], pdf["high"], pdf["side"], pdf["id"], pdf["field"], pdf["span_start"], pdf["span_end"], strict=True):
            # a null bound is no span: it is behind every end, or before every start
            sides[n].append((i, field, low, high, math.inf if pd.isna(start) else start, -math.inf if pd.isna(end) else end))
        if any(r[1] == "offer_price" for r in sides[0]):
            sides[1][:] = [(*r[:4], 0, 0) if r[1] == "offer_price" else r for r in sides[1]]
        out = pd.DataFrame([(pdf["accession"].iloc[0], *r) for r in greedy(*sides)], columns=["accession", "field", "gold_id", "predicted_id"])
        return out.astype({"gold_id": "Int64", "predicted_id": "Int64"})

    both = side(gold, "gold_id", 0).unionByName(side(predicted, "predicted_id", 1))
    return both.groupBy("accession").applyInPandas(pair, "accession string, field string, gold_id long, predicted_id long")


def evaluate(matches: DataFrame, by: str | list[str] | None = "field") -> DataFrame:
    """tp, fp, fn, precision, recall and F1 for each value of ``by``, or overall."""
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
    g, p = F.col("gold_id").isNotNull(), F.col("predicted_id").isNotNull()
    sums = [count(g & p).alias("tp"), count(p & ~g).alias("fp"), count(g & ~p).alias("fn")]
    rows = matches.groupBy(by).agg(*sums) if by else matches.agg(*sums)
    precision, recall, f1 = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.withColumns({"precision": precision, "recall": recall, "f1": f1})


def evaluate_groups(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Scores over the key fields for each (stratum, label) of ``groups`` (accession, stratum, label).

    A label whose filings have no such fact scores zero counts.
    """
    key = matches.where(F.col("field").isin(*KEY_FIELDS))
    return evaluate(groups.distinct().join(key, "accession", "left"), ["stratum", "label"])


def confusion(matches: DataFrame, gold: DataFrame, predicted: DataFrame, attribute: str) -> DataFrame:
    """(accession, want, got, n): values of an attribute over matched pairs whose gold value is not empty."""
    g = gold.select("gold_id", F.col(attribute).alias("want")).where("want <> ''")
    p = predicted.select("predicted_id", F.col(attribute).alias("got"))
    return matches.join(g, "gold_id").join(p, "predicted_id").groupBy("accession", "want", "got").agg(F.count("*").alias("n"))


def bootstrap_precision(matches: DataFrame, filings: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high): 95% interval of key-field precision when filings (accession) are resampled; null without any prediction.

    Filings of equal (tp, fp) are alike, so a draw of filings is a multinomial draw of such classes. Classes are counted in
    Spark; their number is bounded by the counts that one filing can have, not by the filings.
    """
    per = evaluate_groups(matches, filings.select("accession", F.lit("").alias("stratum"), F.col("accession").alias("label")))
    classes = per.groupBy("tp", "fp").agg(F.count("*").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(["tp", "fp"])
        n = s["n"].to_numpy()
        picks = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws)
        tp, fp = picks @ s["tp"].to_numpy(), picks @ s["fp"].to_numpy()
        kept = tp[tp + fp > 0] / (tp + fp)[tp + fp > 0]
        low, high = np.quantile(kept, [0.025, 0.975]) if len(kept) else (None, None)
        return pd.DataFrame({"low": [low], "high": [high]}, dtype=object)

    return classes.groupBy().applyInPandas(draw, "low double, high double")


def attribute_accuracy(matches: DataFrame, gold: DataFrame, predicted: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, n, accuracy) over matches whose gold value is not empty nor ``joint``."""
    both = matches.where("gold_id IS NOT NULL AND predicted_id IS NOT NULL")
    g = gold.select("gold_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, attributes)), F.array(*attributes))).alias("attribute", "want"))
    p = predicted.select("predicted_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, attributes)), F.array(*attributes))).alias("attribute", "got"))
    rows = both.join(g, "gold_id").join(p, ["predicted_id", "attribute"]).where("want <> '' AND want <> 'joint'")
    return rows.groupBy("attribute").agg(F.count("*").alias("n"), F.avg((F.col("want") == F.col("got")).cast("double")).alias("accuracy"))


#: White space of a quote and of a text: what divides words in either.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def locate_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``quotes`` (accession, quote, occurrence) with start, end of the wanted match in its document, white space alike.

    Matches are counted from 1 and do not overlap; ``matches`` says how often a quote was found. Without an occurrence the quote
    must be unique; start is null if it is not, or has fewer matches than wanted. Null and blank quotes and null texts have no match, quotes of an unknown document no row.

    Built-in functions only: the text is split at the quote, whose words may be any white space apart, and the places follow from
    the lengths of the parts and of the matches.
    """
    words = F.filter(F.split("quote", SPACE + "+"), lambda w: w != "")
    literal = lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.when(F.size(words) > 0, F.array_join(F.transform(words, literal), SPACE + "+"))
    both = quotes.withColumn("__p", pattern).join(texts.select("accession", F.col("text").alias("__text")), "accession")
    found = both.withColumns({"__m": F.transform(F.regexp_extract_all("__text", F.col("__p"), F.lit(0)), F.length), "__s": F.transform(F.split("__text", F.col("__p"), -1), F.length)})
    found = found.withColumn("matches", F.coalesce(F.size("__m"), F.lit(0)).cast("int")).withColumn("matches", F.when(F.col("__m").isNull(), 0).otherwise(F.col("matches")))
    k = F.when(F.col("occurrence").isNotNull(), F.col("occurrence")).when(F.col("matches") == 1, F.lit(1))
    k = F.when((k >= 1) & (k <= F.col("matches")), k)
    add = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda x, y: x + y)
    start = add("__s", k) + add("__m", k - 1)
    return found.withColumns({"start": F.when(k.isNotNull(), start), "end": F.when(k.isNotNull(), start + F.get("__m", k - 1))}).drop("__p", "__text", "__m", "__s")

"""Cluster bootstrap of a median at any size: exactly n deals a draw, without n x draws rows.

Deals are dealt into buckets by a hash. How many of a draw's n deals fall into a bucket follows from a binary tree over the buckets:
each node splits its number by a binomial draw that is seeded by the node, so every task walks from the root to its own
bucket and all tasks agree, and a draw's weights sum to n. Within a bucket the number is spread by a multinomial draw.

A draw's median lies near the median of all, so a task gives out, for each draw, two numbers for the values below a range around it and the
values in the range with their weights: a number of rows that grows with the square root of the deals. A draw whose median falls
outside makes the range wider, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written
from .quantiles import exact_quantiles

#: Deals of a bucket, and draws that a task weighs at once.
BUCKET, BLOCK = 4096, 100
#: Half the width of the range, in standard deviations of the share of deals below the median.
WIDTH = 8.0
PART = "draw int, total long, below long, value array<double>, weight array<long>"


def bucket_counts(ends: np.ndarray, bucket: int, draws: int, seed: int) -> np.ndarray:
    """How many deals each draw takes from ``bucket``, where bucket i holds the deals from ends[i] to ends[i + 1] of n = ends[-1]."""
    low, high = 0, len(ends) - 1
    n = np.full(draws, int(ends[-1]), dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        all_, left = int(ends[high] - ends[low]), int(ends[mid] - ends[low])
        taken = np.random.default_rng([seed, 1, low, high]).binomial(n, left / all_ if all_ else 0.0)
        n, low, high = (taken, low, mid) if bucket < mid else (n - taken, mid, high)
    return n


def deal_weights(ends: np.ndarray, bucket: int, draws: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first draw, weights of the bucket's deals for that draw and the next ones) in blocks of ``BLOCK`` draws."""
    size = int(ends[bucket + 1] - ends[bucket])
    n = bucket_counts(ends, bucket, draws, seed)
    rng = np.random.default_rng([seed, 2, bucket])
    for at in range(0, draws, BLOCK):
        yield at, rng.multinomial(n[at : at + BLOCK], np.full(size, 1 / size))


def _weighed(deals: DataFrame, ends: np.ndarray, low: float, high: float, draws: int, seed: int) -> DataFrame:
    """A row for each bucket and draw: values drawn, those below ``low``, and those up to ``high`` with their weights."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("deal_id", na_position="first")
        sizes = pdf["v"].map(len).to_numpy()
        values = np.concatenate(pdf["v"].to_list())
        starts = np.cumsum(sizes) - sizes
        below = np.add.reduceat((values < low).astype(np.int64), starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        middle = np.flatnonzero((values >= low) & (values <= high))
        at_value, back = np.unique(values[middle], return_inverse=True)
        rows = []
        for first, w in deal_weights(ends, int(pdf["bucket"].iloc[0]), draws, seed):
            totals, lows = w @ sizes, w @ below
            for i in range(len(w)):
                n = np.bincount(back, weights=w[i, owner[middle]], minlength=len(at_value)).astype(np.int64)
                some = n > 0
                rows.append((first + i, totals[i], lows[i], at_value[some], n[some]))
        return pd.DataFrame(rows, columns=["draw", "total", "below", "value", "weight"])

    return deals.groupBy("bucket").applyInPandas(draw, PART)


def _median(pdf: pd.DataFrame) -> pd.DataFrame:
    """The median of one draw, or null where it is not in the range."""
    value, weight = np.concatenate(pdf["value"].to_list()), np.concatenate(pdf["weight"].to_list()).astype(np.int64)
    order = np.argsort(value)
    upto = np.cumsum(weight[order]) + pdf["below"].sum()
    total = int(pdf["total"].sum())
    at = [(total - 1) // 2, total // 2]
    found = np.searchsorted(upto, at, side="right")
    inside = total > 0 and at[0] >= pdf["below"].sum() and found[1] < len(order)
    return pd.DataFrame({"draw": [pdf["draw"].iloc[0]], "median": [float(value[order][found].mean()) if inside else None]}, dtype=object)


def draw_medians(pairs: DataFrame, draws: int = 2000, seed: int = 0, bucket: int = BUCKET, width: float = WIDTH) -> DataFrame:
    """(draw, median): the median of ``abs_diff`` in each of ``draws`` samples of as many deals as there are, with replacement.

    A deal brings all of its pairs as often as it is drawn. Pairs without a value are left out; a null deal_id is a deal. A
    deal's pairs are bounded by its advisors, so it is one array. Equal deals and seed give equal medians, however the table
    is partitioned. No pairs give no rows. The driver keeps one number for a bucket.
    """
    own = pairs.where(F.col("abs_diff").isNotNull()).groupBy("deal_id").agg(F.sort_array(F.collect_list(F.col("abs_diff").cast("double"))).alias("v"))
    own = written(own, "deals")
    n = own.count()
    if not n:
        return own.select(F.lit(0).alias("draw"), F.lit(0.0).alias("median"))
    buckets = -(-n // bucket)
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "deal_id"), F.lit(buckets)).cast("int"))
    sizes = {r["bucket"]: r["n"] for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    ends = np.cumsum([0, *(sizes.get(b, 0) for b in range(buckets))])
    every = own.select(F.explode("v").alias("x"))
    while True:
        part = min(0.5, width / (2 * n**0.5))
        low, high = exact_quantiles(every, "x", [0.5 - part, 0.5 + part]).first()["quantiles"]
        medians = written(_weighed(dealt, ends, low, high, draws, seed).groupBy("draw").applyInPandas(_median, "draw int, median double"), "medians")
        if part == 0.5 or not medians.where("median IS NULL").count():
            return medians
        width *= 4


def bootstrap_median(pairs: DataFrame, draws: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(low, high): percentile interval of the median of ``abs_diff`` when deals are resampled; nulls without pairs."""
    tail = (1 - confidence) / 2
    # one row a draw
    return draw_medians(pairs, draws, seed).agg(F.percentile("median", tail).alias("low"), F.percentile("median", 1 - tail).alias("high"))

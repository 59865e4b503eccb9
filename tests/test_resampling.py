"""The cluster bootstrap: weights of a draw sum to the deals, medians and intervals as of plain resampling."""

import random

import numpy as np
import pytest

from docfacts.operators import resampling as B


def test_tree_spreads_exactly_n_deals():
    sizes = [5, 0, 17, 1, 300, 4, 0]
    ends = np.cumsum([0, *sizes])
    counts = np.array([B.bucket_counts(ends, b, 500, 7) for b in range(len(sizes))])
    assert (counts.sum(axis=0) == sum(sizes)).all() and (counts[1] == 0).all()
    # means and variances of a multinomial
    share = np.array(sizes) / sum(sizes)
    assert np.allclose(counts.mean(axis=1), sizes, atol=5 * np.sqrt(sum(sizes) / 500))
    assert np.allclose(counts.var(axis=1), sum(sizes) * share * (1 - share), rtol=0.35)
    for b in (0, 2, 4):
        got = np.concatenate([w for _, w in B.deal_weights(ends, b, 500, 7)])
        assert (got.sum(axis=1) == counts[b]).all() and got.shape == (500, sizes[b])


def sample(n=900, seed=2):
    rng = random.Random(seed)
    return [(f"d{i}" if i else None, round(rng.expovariate(1.0) + (i % 7 == 0), 2) if rng.random() > 0.02 else None) for i in range(n) for _ in range(rng.choice([1, 1, 3]))]


def medians(rows, draws, seed, bucket, spark):
    """The same draws, each sample written out."""
    deals = {}
    for d, v in rows:
        if v is not None:
            deals.setdefault(d, []).append(v)
    from pyspark.sql import functions as F

    n = len(deals)
    buckets = -(-n // bucket)
    names = spark.createDataFrame([(d,) for d in deals], "deal_id string")
    of = {}
    for r in names.select("deal_id", F.pmod(F.xxhash64(F.lit(seed), "deal_id"), F.lit(buckets)).alias("b")).collect():
        of.setdefault(r["b"], []).append(r["deal_id"])
    ends = np.cumsum([0, *(len(of.get(b, [])) for b in range(buckets))])
    weights = {}
    for b, own in of.items():
        own.sort(key=lambda d: (d is not None, d))
        weights |= dict(zip(own, np.concatenate([w for _, w in B.deal_weights(ends, b, draws, seed)]).T, strict=True))
    return [float(np.median(np.concatenate([np.repeat(v, weights[d][i]) for d, v in deals.items()]))) for i in range(draws)]


@pytest.mark.parametrize("width", [B.WIDTH, 0.05, 100.0])
def test_medians_equal_written_out_samples(spark, width):
    rows = sample()
    df = spark.createDataFrame(rows, "deal_id string, abs_diff double").repartition(5)
    got = {r["draw"]: r["median"] for r in B.draw_medians(df, 60, 5, bucket=100, width=width).collect()}
    want = medians(rows, 60, 5, 100, spark)
    assert [got[i] for i in range(60)] == pytest.approx(want)


def test_interval_agrees_with_numpy(spark):
    rows = sample(400)
    got = B.bootstrap_median(spark.createDataFrame(rows, "deal_id string, abs_diff double"), 1500, 1).first()
    deals = {}
    for d, v in rows:
        if v is not None:
            deals.setdefault(d, []).append(v)
    arrays, rng = list(deals.values()), np.random.default_rng(8)
    plain = [np.median(np.concatenate([arrays[j] for j in rng.integers(0, len(arrays), len(arrays))])) for _ in range(1500)]
    assert np.allclose([got["low"], got["high"]], np.quantile(plain, [0.025, 0.975]), atol=0.03)


def test_nothing_and_one_deal(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0)], "deal_id string, abs_diff double")
    assert tuple(B.bootstrap_median(df, 20).first()) == (3.0, 3.0)
    assert tuple(B.bootstrap_median(df.limit(0), 20).first()) == (None, None)

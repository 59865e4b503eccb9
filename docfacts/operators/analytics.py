"""Descriptive statistics over a table of facts.

Facts: deal_id, accession, field, low, high, advisor, subject, analysis, span_start, filing_date, year, sic, company.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import FINANCIAL_SIC2, UNNAMED, midpoint, soft_flags, wilson_interval
from .durable import written
from .quantiles import exact_quantiles, row_ranks
from .relational import as_of_join, band_pairs


def target_dcf(facts: DataFrame, field: str) -> DataFrame:
    """Named advisors' target DCF facts of a field with their midpoint."""
    keep = (F.col("field") == field) & (F.col("subject") == "target") & (F.col("analysis") == "dcf") & ~F.col("advisor").isin(UNNAMED)
    return facts.where(keep).withColumn("mid", midpoint())


def advisor_values(facts: DataFrame, field: str, single_only: bool = False) -> DataFrame:
    """(deal_id, advisor, value): the median midpoint; ``single_only`` keeps advisors with one distinct range in the deal."""
    rows = target_dcf(facts, field)
    keys = ["deal_id", "advisor"]
    if single_only:
        ranges = rows.select(*keys, "low", "high", "mid").distinct()
        return ranges.groupBy(*keys).agg(F.count("*").alias("n"), F.max("mid").alias("value")).where("n = 1").drop("n")
    return rows.groupBy(*keys).agg(F.median("mid").alias("value"))


def pairwise_differences(values: DataFrame) -> DataFrame:
    """One row for each two advisors of a deal, the smaller name first."""
    a = values.select("deal_id", F.col("advisor").alias("advisor_a"), F.col("value").alias("value_a"))
    b = values.select("deal_id", F.col("advisor").alias("advisor_b"), F.col("value").alias("value_b"))
    both = a.join(b, "deal_id").where("advisor_a < advisor_b")
    return both.withColumn("abs_diff", F.abs(F.col("value_a") - F.col("value_b")))


def disagreement(pairs: DataFrame, stored: bool = False) -> DataFrame:
    """One row of statistics of ``abs_diff``; its quantiles are found by selection, so no task reads all pairs. Pairs that are ``stored`` are not written again."""
    d = F.col("abs_diff")
    share = lambda x: F.avg((d >= x).cast("double"))
    pairs = pairs if stored else written(pairs.select("deal_id", "abs_diff"), "pairs")
    q = exact_quantiles(pairs, "abs_diff", [0.5, 0.25, 0.75]).first()["quantiles"]
    stats = pairs.agg(F.count("*").alias("n_pairs"), F.avg(d).alias("mean_pp"), share(1.0).alias("share_ge_1pp"), share(2.0).alias("share_ge_2pp"), F.max(d).alias("max_pp"), F.count_distinct("deal_id").alias("n_deals"))
    named = {name: F.lit(v).cast("double") for name, v in zip(("median_pp", "p25_pp", "p75_pp"), q, strict=True)}
    return stats.withColumns(named).select("n_pairs", "n_deals", *named, "mean_pp", "share_ge_1pp", "share_ge_2pp", "max_pp")


def histogram(rows: DataFrame, column: str, step: float, top: float) -> DataFrame:
    """(bin, n): counts by ``step`` from 0; values from ``top`` on fall into the last bin."""
    bins = F.floor(F.least(F.col(column), F.lit(top - 1e-9)) / step)
    return rows.groupBy(bins.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def ecdf(rows: DataFrame, column: str, parts: int = 256) -> DataFrame:
    """(value, share): distinct values with the share of rows at or below.

    Rows are counted by value first; approximate quantiles of the distinct values cut these into ``parts`` ranges, each of
    which has a running sum of its own, and the sums of the ranges below are added from one row for each range.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 4 * parts).alias("cuts"))
    dealt = counts.withColumn("cuts", cuts.scalar()).select("value", "n", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("range"))
    sums = dealt.groupBy("range").agg(F.sum("n").alias("s"))
    # a row for each range
    below = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("below"), F.sum("s").over(Window.partitionBy()).alias("total"))
    own = dealt.withColumn("c", F.sum("n").over(Window.partitionBy("range").orderBy("value")))
    return own.join(F.broadcast(below), "range").select("value", ((F.col("c") + F.col("below")) / F.col("total")).alias("share"))


def ecdf_steps(rows: DataFrame, column: str) -> DataFrame:
    """(value, step): the empirical distribution with a step for each row, rank over number; rows of equal values have steps of their own.

    Nulls and NaN are left out. The ranks come from a range partition whose sizes are carried over.
    """
    value = F.col(column)
    ranked = row_ranks(rows.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(value.alias("value")), F.col("value"))
    return ranked.select("value", (F.col("rank") / F.col("total")).alias("step"))


def implied_growth_units(facts: DataFrame, window: int = 6000) -> DataFrame:
    """(accession, advisor, subject, covered, implied_high, implied_mid) for each exit-multiple DCF.

    Covered: an implied-growth fact of the same filing and advisor, of any subject, is within ``window`` characters.
    """
    exits = facts.where((F.col("field") == "exit_multiple") & (F.col("analysis") == "dcf") & ~F.col("advisor").isin(UNNAMED))
    unit = ["accession", "advisor", "subject"]
    implied = facts.where("field = 'implied_growth'").select("accession", "advisor", F.col("span_start").alias("at"), F.col("high").alias("g_high"), midpoint().alias("g_mid"))
    implied = implied.groupBy("accession", "advisor", "at", "g_high", "g_mid").agg(F.count("*").alias("n"))
    near = band_pairs(exits.select(*unit, "span_start"), implied, ["accession", "advisor"], "span_start", "at", window)
    # a growth fact near several multiples of a unit counts once
    near = near.select(*unit, "at", "g_high", "g_mid", "n").distinct()
    hits = near.groupBy(*unit).agg(F.max("g_high").alias("implied_high"), F.percentile("g_mid", 0.5, F.col("n")).alias("implied_mid"))
    return exits.select(*unit).distinct().join(hits, unit, "left").withColumn("covered", F.col("implied_high").isNotNull())


def implied_growth_bounds(units: DataFrame, bounds: tuple[float, ...] = (3.0, 4.0, 5.0, 6.0)) -> DataFrame:
    """Shares of covered units above each bound (strictly), by high end and midpoint, with score intervals."""
    each = units.where("covered").withColumn("bound", F.explode(F.array(*map(F.lit, bounds))))
    above = lambda c: F.sum((F.col(c) > F.col("bound")).cast("long"))
    out = each.groupBy("bound").agg(F.count("*").alias("n_covered"), above("implied_high").alias("high_above"), above("implied_mid").alias("mid_above"))
    lo, hi = wilson_interval(F.col("high_above"), F.col("n_covered"))
    return out.withColumns({"high_share": F.col("high_above") / F.col("n_covered"), "mid_share": F.col("mid_above") / F.col("n_covered"), "high_lo": lo, "high_hi": hi})


def deal_rates(facts: DataFrame, yields: DataFrame) -> DataFrame:
    """A row for each deal with a discount rate: median discount and growth, first filing's facts, yield as of that date."""
    disc = target_dcf(facts, "discount_rate").groupBy("deal_id").agg(F.median("mid").alias("discount"))
    growth = target_dcf(facts, "terminal_growth").groupBy("deal_id").agg(F.median("mid").alias("growth"))
    # the first value that is not null, in date order, of each column on its own
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("filing_date", c))).alias(c)
    meta = facts.groupBy("deal_id").agg(*[first(c) for c in ("filing_date", "year", "sic", "company")])
    rows = meta.join(disc, "deal_id").join(growth, "deal_id", "left")
    rows = as_of_join(rows, yields, "filing_date", "date", "dgs10").withColumnRenamed("dgs10", "y10").where("y10 IS NOT NULL")
    return rows.withColumn("sic2", F.substring("sic", 1, 2)).withColumn("financial", F.col("sic2").isin(FINANCIAL_SIC2))


def market_by_year(rates: DataFrame) -> DataFrame:
    """Non-financial deals by year: counts, quartiles of discount, median growth, mean yield."""
    rows = written(rates.where("NOT financial").select("year", "discount", "growth", "y10"), "rates")
    at = lambda q, i: F.get(f"{q}.quantiles", F.lit(i))
    # a row for each year: quantiles are found by selection, and bounded by the calendar
    d, g = (F.broadcast(exact_quantiles(rows, c, p, ["year"]).alias(c)) for c, p in (("discount", [0.5, 0.25, 0.75]), ("growth", [0.5])))
    base = rows.groupBy("year").agg(F.count("*").alias("n"), F.count("growth").alias("growth_n"), F.avg("y10").alias("y10_mean")).alias("b")
    both = base.join(d, F.col("b.year").eqNullSafe(F.col("discount.year"))).join(g, F.col("b.year").eqNullSafe(F.col("growth.year")))
    return both.select("b.year", "b.n", at("discount", 0).alias("discount_median"), at("discount", 1).alias("discount_q25"), at("discount", 2).alias("discount_q75"), at("growth", 0).alias("growth_median"), "growth_n", "y10_mean")


def slope(rates: DataFrame, y: str, fixed_effects: bool = False, x: str = "y10", group: str = "sic2") -> DataFrame:
    """(n, slope): least squares of y on x, pooled or within groups of two rows or more.

    Within-group sums come from one aggregate by group (n, sums, products), so no row is joined back to a mean.
    """
    rows = rates.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(group).alias("g") if fixed_effects else F.lit(0).alias("g"))
    by = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"))
    if fixed_effects:
        by = by.where("n > 1")
    return by.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("cxy")), F.nullif(F.sum(F.col("n") * F.col("vx")), F.lit(0.0))).alias("slope"))


def advisor_table(facts: DataFrame, top: int = 12) -> DataFrame:
    """The ``top`` advisors by target-DCF deals with median discount and growth of non-financial deals; ties by name."""
    industrial = ~F.substring("sic", 1, 2).isin(FINANCIAL_SIC2)
    disc = target_dcf(facts, "discount_rate").where(industrial).groupBy("advisor").agg(F.count_distinct("deal_id").alias("deals"), F.median("mid").alias("discount_median"))
    growth = target_dcf(facts, "terminal_growth").where(industrial).groupBy("advisor").agg(F.median("mid").alias("growth_median"))
    return disc.orderBy(F.desc("deals"), "advisor").limit(top).join(growth, "advisor", "left")


def flags(facts: DataFrame, key: list[str], distance: int = 3000) -> DataFrame:
    """``facts`` with ``flags``: soft flags of each fact, and growth_ge_discount for near pairs with growth high >= discount low.

    ``key`` names a fact uniquely; one with nulls in it has no pairs. Both facts of such a pair get the flag. The facts are read once: of those within
    ``distance`` the least rate and the greatest growth tell whether there is such a pair. An advisor's facts of a filing meet in one task.
    """
    field, at = F.col("field"), F.col("span_start")
    near = Window.partitionBy("accession", "advisor", "subject").orderBy(at.cast("long")).rangeBetween(-distance, distance)
    rate, growth = F.min(F.when(field == "discount_rate", F.col("low"))).over(near), F.max(F.when(field == "terminal_growth", F.col("high"))).over(near)
    pair = F.when(field == "terminal_growth", F.col("high") >= F.col("__rate")).when(field == "discount_rate", F.col("__growth") >= F.col("low"))
    known = reduce(and_, [F.col(c).isNotNull() for c in dict.fromkeys([*key, "accession", "advisor", "subject", "span_start"])])
    own = soft_flags(field, F.col("low"), F.col("high"))
    every = F.array_sort(F.when(known & pair, F.array_append(own, F.lit("growth_ge_discount"))).otherwise(own))
    return facts.withColumns({"__rate": rate, "__growth": growth}).withColumn("flags", F.array_join(every, ";")).drop("__rate", "__growth")


def flag_histogram(flagged: DataFrame) -> DataFrame:
    """(flag, n) over ``;``-joined flags."""
    return flagged.select(F.explode(F.split("flags", ";")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def block_bootstrap_slope(rates: DataFrame, y: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high): percentile interval of the pooled slope when filing years are resampled.

    Years are reduced to their sums first; the draws need only those few rows, which one partition holds.
    """
    by = rates.where(F.col(y).isNotNull()).groupBy("year").agg(F.count("*").alias("n"), F.sum("y10").alias("x"), F.sum(y).alias("y"), F.sum(F.col("y10") * F.col("y10")).alias("xx"), F.sum(F.col("y10") * F.col(y)).alias("xy"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("year")[["n", "x", "y", "xx", "xy"]].to_numpy(float)
        if not len(s):
            return pd.DataFrame({"low": [np.nan], "high": [np.nan]})
        pick = np.random.default_rng(seed).integers(0, len(s), (draws, len(s)))
        n, x, v, xx, xy = s[pick].sum(axis=1).T
        var = xx - x * x / n
        b = (xy - x * v / n)[var > 1e-12] / var[var > 1e-12]
        return pd.DataFrame({"low": [np.quantile(b, 0.025)], "high": [np.quantile(b, 0.975)]}) if len(b) else pd.DataFrame({"low": [np.nan], "high": [np.nan]})

    # a row for each year: one partition is bounded by the calendar
    return by.coalesce(1).mapInPandas(lambda parts: iter([draw(pd.concat(list(parts)))]), "low double, high double")

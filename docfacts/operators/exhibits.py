"""The data of the exhibits: what a chart of the results shows, as tables of a bounded number of rows, or a row for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import NOMINAL_GROWTH, wilson_interval
from . import analytics as A

#: Fewest deals of a year whose median growth is shown; last place of the rates' axis at least.
GROWTH_DEALS, AXIS = 3, 14


def rates_by_year(by_year: DataFrame) -> DataFrame:
    """(year, discount_q25, discount_q75, discount_median, y10_mean, growth_median, axis_top) from ``analytics.market_by_year``.

    Growth is null in years with fewer than ``GROWTH_DEALS`` values. ``axis_top`` is the even number of percent that the axis needs.
    """
    need = F.greatest(F.lit(float(AXIS)), F.coalesce(F.max("discount_q75"), F.lit(0.0)) + 1).cast("int")
    top = by_year.agg((need + need % 2).alias("top")).scalar()
    growth = F.when(F.col("growth_n") >= GROWTH_DEALS, F.col("growth_median"))
    return by_year.select("year", "discount_q25", "discount_q75", "discount_median", "y10_mean", growth.alias("growth_median"), top.alias("axis_top"))


def disagreement_bars(pairs: DataFrame, highlight: float = 1.0, step: float = 0.5, top: float = 5.0) -> DataFrame:
    """(left, n, highlighted, share_highlighted): all bars from 0 to ``top``, empty ones too; values from ``top`` on are in the last.

    A bar is highlighted if it begins at ``highlight`` or later; the share is that of pairs, not of bars. No pairs: bars of 0, a null share.
    """
    bars = pairs.sparkSession.range(round(top / step)).withColumnRenamed("id", "bin")
    share = pairs.agg(F.avg((F.col("abs_diff") >= highlight).cast("double")).alias("s")).scalar()
    left = F.col("bin") * step
    return bars.join(A.histogram(pairs, "abs_diff", step, top), "bin", "left").select(left.alias("left"), F.coalesce("n", F.lit(0)).alias("n"), (left >= highlight).alias("highlighted"), share.alias("share_highlighted"))


def implied_growth_steps(units: DataFrame, bound: float = NOMINAL_GROWTH) -> DataFrame:
    """(value, step, above, share_above, axis_low, axis_high): a step for each covered unit by its implied growth, and the share above ``bound``.

    The axis goes from the least value or -2 to the greatest or 14, in whole percent, whichever shows more below and less above.
    """
    covered = units.where("covered")
    stats = covered.agg(F.avg((F.col("implied_high") > bound).cast("double")).alias("share"), F.least(F.lit(-2.0), F.floor(F.min("implied_high"))).alias("low"), F.least(F.lit(14.0), F.ceil(F.max("implied_high"))).alias("high"))
    steps = A.ecdf_steps(covered, "implied_high")
    return steps.withColumns({"above": F.col("value") > bound, "share_above": stats.select("share").scalar(), "axis_low": stats.select("low").scalar(), "axis_high": stats.select("high").scalar()})


def score_points(evaluated: DataFrame) -> DataFrame:
    """(split, field, metric, value, low, high) in percent from scores by field (split, field, tp, fp, fn): precision and recall with score intervals.

    A metric without any case has no point.
    """
    both = evaluated.select("split", "field", F.explode(F.array(F.struct(F.lit("precision").alias("metric"), "tp", (F.col("tp") + F.col("fp")).alias("n")), F.struct(F.lit("recall").alias("metric"), "tp", (F.col("tp") + F.col("fn")).alias("n")))).alias("s")).select("split", "field", "s.*").where("n > 0")
    low, high = wilson_interval(F.col("tp"), F.col("n"))
    return both.select("split", "field", "metric", (100 * F.col("tp") / F.col("n")).alias("value"), (100 * low).alias("low"), (100 * high).alias("high"))

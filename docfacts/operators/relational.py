"""Relational operators of the fact pipeline that Spark has no single operator for.

All are plans of joins and map-side combined aggregates. Where a key may be frequent the plan pre-aggregates before it
shuffles, so that no operator needs all rows of a key in one task unless its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, values: DataFrame, on: str, date: str, value: str) -> DataFrame:
    """``left`` with ``value``, the last one on or before its date ``on``; null before the first observation.

    An equality join with a calendar, never a range join. ``values`` holds one row a day at most, so the calendar and the window
    over it are small; dates behind its end look up its last day, which is a scalar of the plan. ``left`` is read once.
    """
    known = values.select(F.col(date).cast("date").alias("__from"), F.col(value).alias(value)).dropna()
    until = F.coalesce(F.date_sub(F.lead("__from").over(Window.orderBy("__from")), 1), F.col("__from"))
    days = known.withColumn("__to", until).select(F.explode(F.sequence("__from", "__to")).alias("__day"), value)
    day = F.col(on).cast("date")
    asked = F.when(day.isNotNull(), F.least(day, known.agg(F.max("__from")).scalar()))
    return left.withColumn("__on", asked).join(days, F.col("__on") == F.col("__day"), "left").drop("__on", "__day")


def as_of_by_key(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, values: list[str], strict: bool = True) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its keys at a position below (or at) its own.

    Union and a running last value: one shuffle on the keys, no range join. A document's rows meet in one task.
    """
    payload = F.struct(*[F.col(v).alias(v) for v in values], F.col(right_pos).alias(right_pos))
    ls = left.select(F.struct(*left.columns).alias("__l"), *keys, F.col(left_pos).alias("__p"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("__r"), F.lit(0 if strict else 1).alias("__o"))
    rs = right.select(F.lit(None).cast(ls.schema["__l"].dataType).alias("__l"), *keys, F.col(right_pos).alias("__p"), payload.alias("__r"), F.lit(1 if strict else 0).alias("__o"))
    w = Window.partitionBy(*keys).orderBy("__p", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = ls.unionByName(rs).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__l IS NOT NULL")
    return both.select("__l.*", *[F.col(f"__last.{v}").alias(v) for v in values], F.col(f"__last.{right_pos}").alias(f"{right_pos}_at"))


def contained_in(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the span of their keys that holds them, start <= at < end, or nulls: equality on keys, bounds as residual."""
    right = spans.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(at) >= F.col(start), F.col(at) < F.col(end)]
    return points.join(right, on, "left").drop(*[f"__{k}" for k in keys])


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, width: int) -> DataFrame:
    """Pairs of equal keys whose positions are within ``width``, inclusive.

    Positions are cut into bands of ``width``; a right row meets its own band and both neighbours, so the join is by
    equality and a frequent key is split by its positions.
    """
    band = lambda c: F.floor(F.col(c) / width).cast("long")
    r = right.withColumn("__b", F.explode(F.array(*[band(right_pos) + d for d in (-1, 0, 1)])))
    both = left.withColumn("__b", band(left_pos)).join(r, [*keys, "__b"]).drop("__b")
    return both.where(F.abs(F.col(left_pos) - F.col(right_pos)) <= width)


def sessions(rows: DataFrame, key: str, date: str, days: int, name: str) -> DataFrame:
    """``rows`` with the session number ``name`` of each: a gap of more than ``days`` days to the row before starts one.

    Only distinct dates of a key are ordered; their number is bounded by the calendar, however frequent the key is.
    """
    if days <= 0:
        raise ValueError("the window must be positive")
    dates = rows.select(key, F.col(date).cast("date").alias("__d")).where("__d IS NOT NULL").distinct()
    w = Window.partitionBy(key).orderBy("__d")
    starts = dates.withColumn("__new", (F.datediff("__d", F.lag("__d").over(w)) > days).cast("long"))
    numbered = starts.withColumn(name, F.sum(F.coalesce("__new", F.lit(0))).over(w)).select(F.col(key).alias("__k"), "__d", name)
    return rows.join(numbered, F.col(key).eqNullSafe(F.col("__k")) & (F.col(date).cast("date") == F.col("__d")), "left").drop("__k", "__d")


def keep_first(rows: DataFrame, key: list[str], order: list[str], counted: str, count_name: str) -> DataFrame:
    """The first row of each key in ``order``, with the number of distinct ``counted`` values of the key.

    Two map-side combined aggregates, joined on the key; no window, so a frequent key is pre-aggregated.
    """
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, F.struct(*others).alias("__row"))).alias("__m"), F.count_distinct(counted).cast("long").alias(count_name))
    return first.select(*key, "__m.__row.*", count_name)


def round_robin(rows: DataFrame, stratum: str, quota: int, tie: str, seed: int = 0, shuffle: Column | None = None) -> DataFrame:
    """``quota`` rows taken in turns from strata, larger strata first; order within a stratum is a seeded hash.

    Only the first ``quota`` rows of a stratum are ranked further (Spark limits the window's groups before its shuffle).
    """
    size = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), tie) if shuffle is None else shuffle, tie)
    turn = rows.withColumn("__turn", F.row_number().over(w)).where(F.col("__turn") <= quota)
    return turn.join(size, stratum).orderBy("__turn", F.desc("__n"), stratum).limit(quota).drop("__n", "__turn")

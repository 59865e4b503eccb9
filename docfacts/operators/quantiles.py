"""Exact quantiles and row ranks of columns of any size, without one task that reads all values.

A quantile's ranks are found by selection: a sketch of the rows that can still hold a rank gives cut points, exact counts between
the cut points tell where the rank is, and only that range is looked at further. A round leaves a few thousandths of the rows,
so a trillion rows need four rounds; what is left fits a task. Equal values are counted apart, so ties end the search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .durable import written

#: Cut points of a round's sketch, and its accuracy: a cut point's rank is off by at most one part in so many.
GRID, ACCURACY = 512, 10_000
#: Values of one rank's range that one task sorts.
LIMIT = 100_000


def _narrow(x: DataFrame, opened: dict[tuple[int, int], dict], limit: int, grid: int) -> None:
    """Replaces each range of ``opened`` by the part of it that holds its rank; all of them in two passes."""
    spark = x.sparkSession
    ranges = spark.createDataFrame([(g, r, o["low"], o["high"]) for (g, r), o in opened.items()], "g int, r long, low double, high double")
    inside = lambda t: x.join(F.broadcast(t), "g").where("x BETWEEN low AND high")
    cuts = inside(ranges).groupBy("g", "r").agg(F.percentile_approx("x", [i / grid for i in range(grid + 1)], ACCURACY).alias("cuts")).collect()
    rows = []
    for c in cuts:
        o = opened[c["g"], c["r"]]
        at = int((c["r"] - o["below"]) / o["n"] * grid)
        rows.append((c["g"], c["r"], o["low"], o["high"], c["cuts"][max(0, at - 1)], c["cuts"][min(grid, at + 2)]))
    parts = spark.createDataFrame(rows, "g int, r long, low double, high double, a double, b double")
    part = F.when(F.col("x") < F.col("a"), 0).when(F.col("x") == F.col("a"), 1).when(F.col("x") < F.col("b"), 2).when(F.col("x") == F.col("b"), 3).otherwise(4)
    counted = inside(parts).groupBy("g", "r", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    for c in sorted(counted, key=lambda c: (c["g"], c["r"], c["part"])):
        o = opened[c["g"], c["r"]]
        before = o.setdefault("at", o["below"])
        o["at"] += c["n"]
        if before <= c["r"] < o["at"]:
            o["next"] = {"below": before, "n": c["n"], "low": c["low"], "high": c["high"]}
    for key, o in list(opened.items()):
        opened[key] = o["next"]


def exact_quantiles(rows: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, limit: int = LIMIT, grid: int = GRID) -> DataFrame:
    """(by, n, quantiles array<double>): interpolated quantiles of ``column``, equal to Spark's ``percentile``.

    ``by`` may have a bounded number of groups, such as years: their ranks are kept by the driver, a few numbers each. Nulls
    and NaN are no values; a group without values, and an empty table without ``by``, have null quantiles and n 0. ``rows`` is read once and its
    column written, then read twice a round, with one row a task, rank and part to the driver.
    """
    by = by or []
    spark = rows.sparkSession
    value = F.col(column).cast("double")
    keys = [f"__k{i}" for i in range(len(by))]
    own = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.when(~F.isnan(value), value).alias("x"))
    # a zero's sign is no difference of values
    own = own.withColumn("x", F.when(F.col("x") == 0, F.lit(0.0)).otherwise(F.col("x")))
    named = own.select(*keys).distinct()
    number = dict(enumerate(map(tuple, named.collect()))) if by else {0: ()}
    if by:
        table = spark.createDataFrame([(i, *k) for i, k in number.items()], named.select(F.lit(0).alias("g"), *[F.col(k).alias(f"_{k}") for k in keys]).schema)
        x = own.join(F.broadcast(table), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select("g", "x")
    else:
        x = own.select(F.lit(0).alias("g"), "x")
    x = written(x.where("x IS NOT NULL"), "quantiles")
    groups = {r["g"]: r for r in x.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    ranks: dict[tuple[int, int], dict] = {}
    for g, r in groups.items():
        for p in probabilities:
            for at in {math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1))}:
                ranks[g, at] = {"below": 0, "n": r["n"], "low": r["low"], "high": r["high"]}
    while opened := {k: o for k, o in ranks.items() if o["n"] > limit and o["low"] < o["high"]}:
        _narrow(x, opened, limit, grid)
        ranks |= opened
    found = {k: o["low"] for k, o in ranks.items() if o["low"] == o["high"]}
    if left := [(g, r, r - o["below"] + 1, o["low"], o["high"]) for (g, r), o in ranks.items() if (g, r) not in found]:
        t = spark.createDataFrame(left, "g int, r long, nth int, low double, high double")
        # at most ``limit`` values a rank
        sorted_ = x.join(F.broadcast(t), "g").where("x BETWEEN low AND high").groupBy("g", "r", "nth").agg(F.sort_array(F.collect_list("x")).alias("s"))
        found |= {(r["g"], r["r"]): r["v"] for r in sorted_.select("g", "r", F.element_at("s", F.col("nth")).alias("v")).collect()}
    out = []
    for g, key in number.items():
        n = groups[g]["n"] if g in groups else 0
        q = []
        for p in probabilities:
            at = p * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            q.append(None if not n else found[g, low] if low == high else (high - at) * found[g, low] + (at - low) * found[g, high])
        out.append((*key, n, q))
    schema = named.withColumnsRenamed(dict(zip(keys, by, strict=True))).schema if by else StructType()
    return spark.createDataFrame(out, StructType([*schema.fields, StructField("n", LongType()), StructField("quantiles", ArrayType(DoubleType()))]))


def row_ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3, ... over all rows in ``order``, and ``total``, their number.

    A range partition by ``order``, row numbers within partitions, and the partitions' sizes carried over: no task holds more
    than its range, and the driver one number for each. Rows that tie are numbered in any order.
    """
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    starts = F.array(*[F.lit(n).cast("long") for n in before or [0]])
    return placed.withColumns({"rank": F.element_at(starts, part + 1) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1, "total": F.lit(total).cast("long")}).drop("__at")

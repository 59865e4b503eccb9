"""The tree of results: all analyses of a fact table as one nested row, and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..functions.expressions import CORE_FIELDS, NOMINAL_GROWTH, tier
from . import analytics as A
from .durable import written
from .resampling import bootstrap_median


def _clean(c: Column, kind: DataType) -> Column:
    """``c`` without what JSON lacks: NaN is null, at any depth; struct fields whose names start with ``_`` are left out."""
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, StructType):
        kept = [f for f in kind.fields if not f.name.startswith("_")]
        return F.when(c.isNotNull(), F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kept]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType))
    return c


def strip_private(df: DataFrame) -> DataFrame:
    """``df`` without columns and nested fields whose names start with ``_``, and with nulls for NaN."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not f.name.startswith("_")])


def _one(df: DataFrame, name: str) -> DataFrame:
    """One row: a frame of one row as a struct."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def _list(df: DataFrame, name: str, *order: str) -> DataFrame:
    """One row: a frame of a bounded number of rows as an array, in ``order``."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r")))).alias("a")).select(F.transform("a", lambda x: x["_r"]).alias(name))


def _counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    """One row: a map from each of few keys to its number of rows."""
    n = df.where(key.isNotNull()).groupBy(key.cast("string").alias("k")).agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def _beside(parts: list[DataFrame]) -> DataFrame:
    """One-row frames side by side: each is a scalar of one plan, so none is a join of rows."""
    first, *rest = parts
    return first.withColumns({c: p.select(c).scalar() for p in rest for c in p.columns})


def disagreement(facts: DataFrame, field: str, draws: int, seed: int, single_only: bool = False) -> DataFrame:
    """One row: ``analytics.disagreement`` of a field, with the interval of its median."""
    pairs = written(A.pairwise_differences(A.advisor_values(facts, field, single_only)).select("deal_id", "abs_diff"), "pairs")
    interval = bootstrap_median(pairs, draws, seed).select(F.when(F.col("low").isNotNull(), F.array("low", "high")).alias("median_ci_95"))
    return _beside([A.disagreement(pairs, stored=True), interval])


def corpus(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """One row: numbers of filings, deals and facts, by field, tier and year, and of flags; ``facts`` have ``flags``."""
    core = F.col("field").isin(CORE_FIELDS)
    f = filings.agg(F.count_distinct("accession").alias("n_filings"), F.count_distinct("deal_id").alias("n_deals"), F.array(F.min(F.year(F.to_date("file_date"))), F.max(F.year(F.to_date("file_date")))).alias("filing_years"))
    totals = facts.agg(
        F.count("*").alias("n_facts"), F.count_if(core).alias("n_core_facts"), F.count_distinct("deal_id").alias("n_deals_with_facts"), F.count_distinct(F.when(core, F.col("deal_id"))).alias("n_deals_with_core_facts"),
        F.avg(F.when(core, (F.col("advisor") == "unattributed").cast("double"))).alias("unattributed_share_of_core"),
    )
    each = facts.select(F.explode(F.split(F.coalesce("flags", F.lit("")), ";")).alias("flag")).where("flag <> ''")
    return _beside([f, totals, _counts(facts, F.col("field"), "facts_by_field"), _counts(facts, tier(F.col("field")), "facts_by_tier"), _counts(facts, F.col("year"), "facts_by_year"), _counts(each, F.col("flag"), "soft_flag_counts")])


def practice(rates: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row: slopes of discount and growth on the yield, pooled with its interval and within industries."""
    def of(y: str) -> Column:
        pooled, within = (A.slope(rates, y, fixed_effects=e) for e in (False, True))
        interval = A.block_bootstrap_slope(rates, y, draws, seed)
        return F.struct(pooled.select("n").scalar().alias("n"), pooled.select("slope").scalar().alias("pooled_slope"), within.select("n").scalar().alias("within_n"), within.select("slope").scalar().alias("within_slope"), F.array(interval.select("low").scalar(), interval.select("high").scalar()).alias("ci_95_year_block_bootstrap"))

    return rates.sparkSession.range(1).select(of("discount").alias("discount"), of("growth").alias("growth"))


def example(facts: DataFrame, company: str, most: int = 1000) -> DataFrame:
    """One row: the target-like DCF values of the first deal of companies whose name holds ``company``, at most ``most`` of them."""
    own = facts.where(F.contains(F.lower("company"), F.lower(F.lit(company))))
    deal = own.agg(F.min("deal_id").alias("deal_id"))
    rows = own.where((F.col("deal_id") == deal.scalar()) & F.col("field").isin("discount_rate", "terminal_growth", "exit_multiple", "implied_growth") & (F.col("analysis") == "dcf"))
    few = rows.orderBy("advisor", "span_start", "field", "low", "high", "subject").limit(most).select("advisor", "span_start", "field", "low", "high", "subject")
    listed = _list(few, "facts", "advisor", "span_start", "field", "low", "high", "subject")
    return _beside([deal, listed])


def result_tree(facts: DataFrame, filings: DataFrame, yields: DataFrame, draws: int = 2000, seed: int = 0, company: str | None = None, stored: bool = False, **more: DataFrame) -> DataFrame:
    """One row of nested structs: seed, draws, corpus and analyses of a released table, and ``more`` one-row frames, such as a verification's report.

    Each analysis is a bounded summary and is computed where its own operator says; the row is assembled from them as scalars of one plan, so
    nothing but summaries meets in it. Names that start with ``_`` are left out and NaN is null. Empty tables give zeros, nulls
    and empty lists. ``facts`` that are ``stored`` as files are read from these, and not written anew.
    """
    facts = facts if stored else written(facts, "facts")
    rates = written(A.deal_rates(facts, yields), "rates")
    open_rates = rates.where("NOT financial")
    units = written(A.implied_growth_units(facts), "units")
    single, every = ([_one(disagreement(facts, f, draws, seed, s), f) for f in ("discount_rate", "terminal_growth")] for s in (True, False))
    covered = units.agg(F.count("*").alias("n_units"), F.count_if("covered").alias("n_covered"), F.avg(F.col("covered").cast("double")).alias("share_covered"))
    parts = {
        "bank_disagreement": _beside(every), "bank_disagreement_single_range_only": _beside(single), "implied_growth": _beside([covered, _list(A.implied_growth_bounds(units), "bounds", "bound")]),
        "market_practice": practice(open_rates, draws, seed), "market_practice_by_year": _list(A.market_by_year(rates), "market_practice_by_year", "year"), "advisor_table": _list(A.advisor_table(facts).withColumn("_n", -F.col("deals")), "advisor_table", "_n", "advisor"),
    }
    if company is not None:
        parts["example"] = example(facts, company)
    analyses = _beside([p if p.columns == [k] else _one(p, k) for k, p in parts.items()]).withColumn("nominal_growth_bound_pct", F.lit(NOMINAL_GROWTH))
    last = yields.agg(F.max("date").cast("string").alias("yields_last_observation"))
    head = facts.sparkSession.range(1).select(F.lit(seed).alias("seed"), F.lit(draws).alias("bootstrap_draws"))
    return strip_private(_beside([head, last, _one(corpus(facts, filings), "corpus"), _one(analyses, "analyses"), *[_one(df, k) for k, df in more.items()]]))


def as_json(tree: DataFrame) -> DataFrame:
    """(json): each row as JSON text, with null fields kept."""
    return tree.select(F.to_json(F.struct(*tree.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(tree: DataFrame, path: str) -> None:
    """The one row as one JSON file below ``path``."""
    as_json(tree).coalesce(1).write.mode("overwrite").text(path)


__all__ = ["as_json", "corpus", "disagreement", "example", "practice", "result_tree", "strip_private", "write_json"]

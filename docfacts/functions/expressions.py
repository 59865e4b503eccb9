"""Column expressions over facts: midpoints, growth algebra, intervals, money, names."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed bounds outside which a fact gets a soft flag.
TYPICAL_BOUNDS = {"discount_rate": (3.0, 25.0), "terminal_growth": (-3.0, 6.0), "implied_growth": (-5.0, 8.0), "exit_multiple": (1.0, 40.0), "implied_multiple": (1.0, 40.0)}
FLAG_NAMES = {"discount_rate": "rate_atypical", "terminal_growth": "growth_atypical", "implied_growth": "growth_atypical", "exit_multiple": "multiple_atypical", "implied_multiple": "multiple_atypical"}
# Closed bounds outside which a candidate is rejected.
HARD_BOUNDS = {
    "discount_rate": (0.0, 60.0), "terminal_growth": (-20.0, 15.0), "implied_growth": (-60.0, 60.0), "exit_multiple": (0.05, 150.0), "implied_multiple": (0.05, 150.0),
    "value_per_share": (0.0, 20000.0), "offer_price": (0.5, 5000.0), "fee_total": (0.01, 500.0), "fee_opinion": (0.01, 500.0), "fee_contingent": (0.01, 500.0),
}
CORE_FIELDS = ["discount_rate", "terminal_growth", "exit_multiple", "implied_growth", "implied_multiple"]
# Names of the metric that a multiple applies to, first that is near wins; short capitals are whole words.
METRICS = {
    "EBITDA": ["EBITDA"], "EBIT": ["EBIT"], "FCF": ["distributable cash", "FCF", "free cash flow"], "P/E": ["earnings", "EPS", "net income", "P/E", "price-to-earnings"], "revenue": ["revenue", "sales"], "book value": ["book value", "NAV", "net asset"], "FFO": ["AFFO", "FFO", "funds from operations"],
}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Longest snippet, and characters around a span that are looked at for a metric.
SNIPPET, METRIC_BEFORE, METRIC_AFTER = 300, 60, 140
UNNAMED = ["unattributed", "joint"]
NOMINAL_GROWTH = 4.0
FINANCIAL_SIC2 = [str(n) for n in range(60, 68)]


def midpoint(low: str = "low", high: str = "high") -> Column:
    return (F.col(low) + F.col(high)) / 2


def implied_perpetuity_growth(multiple: Column, metric: Column, cash_flow: Column, rate: Column, timing: str = "end") -> Column:
    """Growth that an exit multiple implies: (TV r - CF) / (TV + CF) with TV = multiple * metric.

    Mid-year discounting scales the cash flow by sqrt(1 + rate). Null unless all amounts are positive and 0 < rate < 1.
    """
    if timing not in ("end", "mid"):
        raise ValueError("timing must be 'end' or 'mid'")
    value = multiple * metric
    cash = cash_flow * F.sqrt(1 + rate) if timing == "mid" else cash_flow
    valid = (multiple > 0) & (metric > 0) & (cash_flow > 0) & (rate > 0) & (rate < 1)
    return F.when(valid, (value * rate - cash) / (value + cash))


def growth_matches(disclosed: Column, recomputed: Column, rounding: float = 0.15) -> Column:
    return F.abs(disclosed - recomputed) <= rounding


def wilson_interval(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a share, clamped to [0, 1]; null for n = 0."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p = F.try_divide(k, n)
    centre = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * n), 1 + F.try_divide(F.lit(z * z), n))
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)), 1 + F.try_divide(F.lit(z * z), n))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(n > 0, clamp(centre - half)), F.when(n > 0, clamp(centre + half))


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where a denominator is 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.try_divide(2 * tp, 2 * tp + fp + fn)


def tier(field: Column) -> Column:
    return F.when(field.isin(CORE_FIELDS), "core").otherwise("auxiliary")


def fact_id(accession: Column, field: Column, span_start: Column) -> Column:
    return F.concat_ws(":", accession, field, span_start.cast("string"))


def soft_flags(field: Column, low: Column, high: Column) -> Column:
    """Sorted array of the soft flags that a fact earns by itself."""
    flags = [F.when((field == f) & ((low < lo) | (high > hi)), F.lit(FLAG_NAMES[f])) for f, (lo, hi) in TYPICAL_BOUNDS.items()]
    flags.append(F.when((field == "implied_growth") & (high > NOMINAL_GROWTH), F.lit("implied_growth_high")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))


def bounds_problem(field: Column, low: Column, high: Column) -> Column:
    """``reversed_range`` or ``outside_hard_bounds``, null if neither."""
    outside = F.lit(False)
    for f, (lo, hi) in HARD_BOUNDS.items():
        outside = outside | ((field == f) & ((low < lo) | (high > hi)))
    return F.when(low > high, "reversed_range").when(outside, "outside_hard_bounds")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def parse_number(text: Column) -> Column:
    """The number of one end of a value as it is written: 9.0%, (1.0)%, negative 1.5 percent, $1,200.50, $2.5 million; null for none."""
    low = F.lower(F.trim(text))
    n = F.regexp_replace(F.regexp_extract(low, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    scale = F.when(low.contains("thousand"), 1e3).when(low.contains("million"), 1e6).when(low.contains("billion"), 1e9).otherwise(1.0)
    return F.when(low.rlike(r"^(?:negative|minus|\(|[-\u2010-\u2015\u2212])"), -n * scale).otherwise(n * scale)


def metric_of(near: Column, unit: Column) -> Column:
    """The metric of a multiple from the text near it; empty for other units or if none is named."""
    named = F.coalesce(*[F.when(near.rlike(_words(words)), F.lit(m)) for m, words in METRICS.items()], F.lit(""))
    return F.when(unit == "x", named).otherwise("")


def _words(words: list[str]) -> str:
    return "(?i)" + "|".join((r"\b" + w + r"\b" if w.isupper() and len(w) < 5 else w).replace(" ", r"\s+") for w in words)


def valuation_date(sentence: Column, anchor: Column) -> Column:
    """ISO date nearest to a place of a sentence about discounting or value, introduced by as of, to, at or a bracket; else empty.

    Both notations count, month first and day first; dates that do not exist are passed over, of equally near ones the first wins.
    """
    lead = r"(?i)(?:\bas\s+of|\bto|\bat|\()\s*"
    month = "(?:" + "|".join(MONTHS) + ")"
    forms = {rf"({month}\s+[0-9]{{1,2}},?\s+(?:19|20)[0-9]{{2}})": "MMMM d yyyy", rf"([0-9]{{1,2}}\s+{month},?\s+(?:19|20)[0-9]{{2}})": "d MMMM yyyy"}

    def found(pattern: str, form: str) -> Column:
        day = lambda m: F.to_date(F.try_to_timestamp(F.regexp_replace(F.initcap(m), r",?\s+", " "), F.lit(form)))
        away = lambda m: F.abs(F.instr(sentence, m) - 1 - anchor)
        return F.transform(F.regexp_extract_all(sentence, F.lit(lead + pattern), F.lit(1)), lambda m: F.struct(away(m).alias("away"), F.instr(sentence, m).alias("p"), day(m).alias("day")))

    dates = F.filter(F.concat(*[found(p, f) for p, f in forms.items()]), lambda d: d["day"].isNotNull())
    about = sentence.rlike("(?i)present|discount|valu")
    # no test of their number, so that the dates are sought once
    return F.when(about, F.coalesce(F.date_format(F.array_min(dates)["day"], "yyyy-MM-dd"), F.lit(""))).otherwise("")


def fingerprint(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def clean_company_name(name: Column) -> Column:
    """A company's name without a trailing ticker or file-number remark and with single spaces."""
    bare = F.regexp_replace(name, r"\s*\((?:CIK\s+)?[A-Z0-9 ,.\-]+\)", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def money_value(amount: Column, scale: Column, unit: str = "usd") -> Column:
    """A dollar amount with an optional scale word in dollars or millions of dollars."""
    factor = F.when(F.lower(scale) == "thousand", 1e3).when(F.lower(scale) == "million", 1e6).when(F.lower(scale) == "billion", 1e9).otherwise(1.0)
    dollars = F.regexp_replace(amount, ",", "").cast("double") * factor
    return dollars if unit == "usd" else dollars / 1e6


def format_number_g(value: Column) -> Column:
    """A number with at most six decimals and without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")


def format_range(low: Column, high: Column, unit: str = "%") -> Column:
    a, b = format_number_g(low), format_number_g(high)
    return F.when(low == high, F.concat(a, F.lit(unit))).otherwise(F.concat(a, F.lit(unit + " – "), b, F.lit(unit)))

"""Whole filings of many sections: what is planted in them is found, each value with the house and analysis of its own section, and nothing else."""

import html
import random

from docfacts.operators import extraction as X
from docfacts.sources.html import html_to_document

COMPANY = "Northfield Instruments Corporation"
HOUSES = ["Lazard", "Evercore", "Moelis", "Centerview", "Guggenheim", "Jefferies"]
QUIET = ["The directors discussed the timetable with management.", "Counsel described the duties of the directors.", "Members of the committee asked questions and received answers.", "No member of the board had an interest of this kind.", "The meeting was adjourned and resumed on the following day."]
# Own sentences: (analysis, heading, statement with its values, planted fields)
STUDIES = [
    ("dcf", "Discounted Cash Flow Analysis", "{h} performed a discounted cash flow analysis of the Company, using discount rates ranging from {a}% to {b}% and terminal growth rates of {g}% to {k}%.", [("discount_rate", "a", "b"), ("terminal_growth", "g", "k")]),
    ("ddm", "Dividend Discount Analysis", "{h} performed a dividend discount analysis of the Company, using a discount rate of {a}% and terminal multiples of {m}x to {n}x.", [("discount_rate", "a", "a"), ("exit_multiple", "m", "n")]),
    ("dcf", "Discounted Cash Flow Analysis", "{h} calculated terminal values for the Company in its discounted cash flow analysis by applying EBITDA multiples ranging from {m}x to {n}x.", [("exit_multiple", "m", "n")]),
    ("dcf", "Discounted Cash Flow Analysis", "{h} applied to the Company earnings multiples ranging from {m}x to {n}x in order to estimate terminal values for its discounted cash flow analysis.", [("exit_multiple", "m", "n")]),
    ("pv_future_price", "Illustrative Present Value of Future Stock Price", "{h} discounted the illustrative prices of the Company at a cost of equity of {a}%.", [("discount_rate", "a", "a")]),
    ("dcf", "Discounted Cash Flow Analysis", "{h} performed a discounted cash flow analysis of the Company with a {a}% to {b}% WACC, which implied a perpetuity growth rate of {g}% to {k}%.", [("discount_rate", "a", "b"), ("implied_growth", "g", "k")]),
]


def _filing(seed: int) -> tuple[str, list[tuple]]:
    """HTML of a filing, and the facts planted in it in the order of its text."""
    r = random.Random(seed)
    quiet = lambda n: " ".join(r.choice(QUIET) for _ in range(n))
    houses = r.sample(HOUSES, r.choice([1, 2, 3]))
    out: list[tuple[str, str]] = [("h", "Table of Contents")] + [("p", f"Opinion of {h} | {20 + i}") for i, h in enumerate(houses)]
    facts: list[tuple] = []
    price = f"{r.randint(2000, 9000) / 100:.2f}"
    out += [("h", "Background of the Merger"), ("p", quiet(60)), ("p", f"Holders will be entitled to receive ${price} in cash for each share. {quiet(3)}"), ("p", f"At the effective time each share will be converted into the right to receive ${price} in cash, without interest.")]
    facts.append(("offer_price", float(price), float(price), "unattributed", ""))
    for h in houses:
        out += [("h", f"Opinion of {h}"), ("p", quiet(r.randint(10, 80)))]
        for analysis, heading, text, fields in r.sample(STUDIES, r.randint(1, 3)):
            a, g, m = r.randint(70, 130) / 10, r.randint(10, 30) / 10, r.randint(60, 120) / 10
            v = {"a": a, "b": round(a + r.randint(5, 25) / 10, 1), "g": g, "k": round(g + r.randint(2, 9) / 10, 1), "m": m, "n": round(m + r.randint(5, 30) / 10, 1)}
            out += [("h", heading), ("p", text.format(h=h, **v) + " " + quiet(r.randint(2, 30))), ("p", "Year | Value"), ("p", "2026 | 11.0% | 12.0%")]
            facts += [(f, v[lo], v[hi], h, analysis) for f, lo, hi in fields]
        fee = r.randint(50, 400) / 10
        out += [("h", "Selected Public Companies Analysis"), ("p", quiet(20)), ("p", f"The Company has agreed to pay {h} an aggregate fee of ${fee} million for its services.")]
        facts.append(("fee_total", fee, fee, h, ""))
    out += [("h", "Certain Financial Projections"), ("p", quiet(200)), ("p", "Management used a discount rate of 8.5% to plan its budget.")]
    return "".join(f"<p><b>{html.escape(t)}</b></p>" if kind == "h" else f"<p>{html.escape(t)}</p>" for kind, t in out), facts


def test_planted_values_of_long_filings(spark):
    made = [_filing(seed) for seed in range(60)]
    docs = spark.createDataFrame([(i, COMPANY, h) for i, (h, _) in enumerate(made)], "k long, company string, html string")
    texts = html_to_document(docs, "html", "k").join(docs.select("k", "company"), "k")
    rows = X.extract(texts, "k", lines="lines", company="company").orderBy("k", "start", "n").collect()
    assert min(len(h) for h, _ in made) > 10_000
    for i, (_, want) in enumerate(made):
        own = [r for r in rows if r["k"] == i]
        assert [(r["field"], r["low"], r["high"], r["advisor"], r["analysis"]) for r in own if r["reason"] is None] == want, i
        # the plan's rate is kept with its reason
        assert [r["reason"] for r in own if r["low"] == 8.5 and r["reason"]] == ["outside_analysis_context"], i


def test_multiples_of_terminal_values_and_multiples_told_again(spark):
    cases = [
        ("applied price to 2022 earnings per share multiples range of 13.0x to 18.0x referred to above", [(13.0, 18.0)]),
        ("applied an EPS multiple range of 9.0x to 10.0x referred to above", [(9.0, 10.0)]),
        ("an EPS multiple range of 9.0x to 10.0x", []),
        ("applied EBITDA multiples of 8.0x to 9.5x to estimate a terminal value", [(8.0, 9.5)]),
        ("applied EBITDA multiples of 8.0x to 9.5x. A terminal value followed", []),
        ("the terminal year by applying a range of 7.0x to 8.0x", [(7.0, 8.0)]),
        ("a terminal enterprise value to next twelve months adjusted EBITDA multiple of 9.0x", [(9.0, 9.0)]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k long, text string")
    rows = X.candidates(X.lexemes(docs, "text", "k"), "k").orderBy("k", "n").collect()
    for i, (text, want) in enumerate(cases):
        assert [(r["low"], r["high"]) for r in rows if r["k"] == i and r["field"] == "exit_multiple"] == want, text

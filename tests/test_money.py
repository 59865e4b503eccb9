"""Fees, offer prices and values per share in context: each word group in sentences of its own, with what it must give."""

import pytest

from docfacts.operators import extraction as X
from docfacts.operators.lexing import lexemes, marks

FEES = [
    ("Lazard will receive a fee of $5 million.", [("fee_total", 5.0)]),
    ("Lazard will receive compensation of $5 million.", [("fee_total", 5.0)]),
    ("Evercore will receive an aggregate fee of approximately $21.8 million, of which $4.5 million became payable upon delivery of its opinion and $17.3 million is contingent upon the closing of the merger.", [("fee_contingent", 17.3), ("fee_opinion", 4.5), ("fee_total", 21.8)]),
    ("The Company will pay Lazard a fee of $2 million upon the rendering of its opinion.", [("fee_opinion", 2.0), ("fee_total", 2.0)]),
    ("The Company will pay Lazard a fee of $2 million upon the issuance of its opinion, which will be credited.", [("fee_opinion", 2.0)]),
    ("Lazard earned an opinion fee of $3 million.", [("fee_opinion", 3.0), ("fee_total", 3.0)]),
    ("Lazard will be paid a contingent fee of $7 million.", [("fee_total", 7.0)]),
    ("Lazard will be paid a fee of $9 million, $1 million payable when its opinion was delivered and the balance due at closing.", [("fee_total", 9.0)]),
    ("UBS is entitled to a fee of $4 million at the consummation of the merger.", [("fee_total", 4.0)]),
    ("UBS is entitled to a fee of $4 million, $3 million payable on completion of the merger.", [("fee_contingent", 3.0), ("fee_total", 4.0)]),
    ("Goldman Sachs advised Parent. The Company must pay a termination fee of $120 million.", []),
    ("In the past two years Lazard had fees of $3 million.", []),
    ("Lazard will get a fee. The plant cost $3 million.", []),
    ("A stranger will receive a fee of $5 million.", []),
    ("Lazard will receive a fee between $3 million and $5 million.", []),
]
OFFERS = [
    ("Each share will be converted into the right to receive $62.00 in cash, without interest.", 62.0),
    ("Holders get an amount in cash equal to $20.00 for each share.", None),
    ("Parent agreed to pay $20.00 per share in cash.", 20.0),
    ("It is an offer at a price of $20.00 in cash and no more.", 20.0),
    ("The right to receive $20.00 in cash and 0.776 of a share of Parent common stock.", None),
    ("The right to receive $20.00 in cash, plus one share of Parent.", None),
    ("The right to receive $20.00 in cash and, for each share, nothing more.", 20.0),
    ("A holder of an option will receive $20.00 in cash.", None),
    ("Holders of preferred stock will receive $20.00 in cash.", None),
    ("The right to receive $20.00 of notes.", None),
    ("The initial proposal was a price of $20.00 in cash.", None),
    ("A break-up fee of $15.00 in cash applies.", None),
    ("The right to receive $0.10 in cash.", None),
]
SHARES = [
    ("This analysis implied a range of values per share of $48.00 to $64.00 for Altra common stock.", (48.0, 64.0)),
    ("It resulted in illustrative present values of $48.00 to $64.00 per share.", (48.0, 64.0)),
    ("It yielded $48.00 to $64.00 per unit.", (48.0, 64.0)),
    ("The stock traded between $48.00 and $64.00 per share during the period.", None),
    ("The implied values per share beside the 52-week closing price were $48.00 to $64.00.", None),
    ("Analysts' price targets indicated $48.00 to $64.00 per share.", None),
    ("This implied $48.00 to $64.00 in all.", None),
    ("Implied values per share: | $48.00 to $64.00 | 7", None),
    ("It implied values per share of $64.00 to $48.00.", None),
    ("It implied values per share of $48.00 to $64.00 in cash.", None),
]


def run(spark, texts, what):
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return what(lexemes(docs, "text", "k", prefilter=False), "k").collect()


def test_fees(spark):
    got = run(spark, [t for t, _ in FEES], X.money_terms)
    for k, (text, want) in enumerate(FEES):
        assert sorted((r["field"], r["low"]) for r in got if r["k"] == k) == want, text


def test_offers_need_two_votes(spark):
    twice = run(spark, [f"{t} {t}" for t, _ in OFFERS], X.offer_price)
    for k, (text, want) in enumerate(OFFERS):
        assert [r["low"] for r in twice if r["k"] == k] == ([] if want is None else [want]), text
    assert run(spark, [t for t, _ in OFFERS], X.offer_price) == []


def test_values_per_share(spark):
    got = run(spark, [t for t, _ in SHARES], X.money_terms)
    for k, (text, want) in enumerate(SHARES):
        assert [(r["low"], r["high"]) for r in got if r["k"] == k] == ([] if want is None else [want]), text


@pytest.mark.parametrize(("text", "want"), [("a fee of $5", ["unlike", "fee_word", "amount"]), ("values per share", ["derived", "unlike", "share"]), ("$5.00 per share", ["amount", "share"]), ("and 0.5 of a share", ["plus", "paper"]), ("", [])])
def test_marks(text, want):
    assert [m["name"] for m in marks(text, 0, len(text))] == want


OTHER = ["a termination fee", "a break-up fee", "in the past two years a fee", "for the preceding year a fee", "over a two-year period a fee", "for unrelated work a fee", "Lazard have received a fee", "they received aggregate fees", "a financing fee", "as underwriters a fee", "as placement agent a fee", "as book-runner a fee", "as co-managers a fee", "expenses and a fee", "to reimburse a fee", "to a director a fee", "to solicit proxies a fee", "may pay a fee", "an additional fee"]


def test_words_of_other_payments(spark):
    assert run(spark, [f"Lazard was there, and {o} of $5 million." for o in OTHER], X.money_terms) == []
    assert len(run(spark, ["Lazard will get a fee of $5 million."], X.money_terms)) == 1


IMPLIED = [("implied perpetuity growth rates of 2.0%", True), ("implies a perpetuity growth rate of 2.0%", True), ("implying a range of illustrative perpetuity growth rates of 2.0%", True), ("implied by the perpetuity growth rate of 2.0%", False), ("implied values, and a perpetuity growth rate of 2.0%", False), ("implied a a a a a perpetuity growth rate of 2.0%", False)]


def test_words_between_implied_and_its_cue(spark):
    got = run(spark, [f"This {t}." for t, _ in IMPLIED], X.candidates)
    assert [r["field"] for r in sorted(got, key=lambda r: r["k"])] == ["implied_growth" if w else "terminal_growth" for _, w in IMPLIED]

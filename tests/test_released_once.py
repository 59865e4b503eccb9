"""A released table is made of one reading of its documents, and of reasons and dates that are worked out once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from docfacts.functions import expressions as E
from docfacts.operators import analytics as A
from docfacts.operators import extraction as X
from docfacts.operators import finalize as Z
from docfacts.operators import lexing as L


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_once_and_reasons_found_once(spark):
    docs = spark.createDataFrame([("a", "Opinion of the Financial Advisor\nLazard performed a discounted cash flow analysis as of March 31, 2020 with a discount rate of 9.0%. Then a discount rate of 99.0%.", [(0, 32, 0.0, 0.0)])], "accession string, text string, lines array<struct<start:int,end:int,bold:double,linked:double>>")
    found = X.extract(docs, "accession", lines="lines")
    filings = docs.select("accession", F.lit("D").alias("deal_id"), F.lit("1").alias("cik"), F.lit("C").alias("company"), F.lit("1000").alias("sic"), F.lit("2020-06-01").alias("file_date"))
    out = Z.finalize(X.accepted(found), filings)
    made = plan(out)
    assert made.count("MapInArrow") == 1
    assert made.count("provenance:") == 1 and made.count("MMMM d yyyy") == 1
    assert [tuple(r) for r in out.select("low", "valuation_date", "flags").collect()] == [(9.0, "2020-03-31", "")]
    kept = sorted(map(str, X.accepted(found).collect()))
    assert kept == sorted(str(r) for r in found.collect() if r["reason"] is None)


def test_near_pairs_are_found_without_pairing(spark):
    draw = random.Random(4)
    pick = lambda *of: draw.choice(of)
    rows = [(i, pick("a", "b", None), pick("discount_rate", "terminal_growth", "exit_multiple"), pick("S", "T", None), "t", pick(0, 0, 2999, 3000, 3001, 6001, None), pick(1.0, 4.0, float("nan"), None), pick(3.0, 4.0, 5.0, float("nan"), None)) for i in range(400)]
    facts = spark.createDataFrame(rows, "i int, accession string, field string, advisor string, subject string, span_start int, low double, high double")
    key = ["accession", "field", "advisor", "subject", "span_start", "low", "high"]
    above = lambda h, low: h is not None and low is not None and (h != h or (low == low and h >= low))  # noqa: E731  as Spark orders NaN
    want = set()
    for g in rows:
        for r in rows:
            if g[2] == "terminal_growth" and r[2] == "discount_rate" and None not in (g[1], g[3], g[5], r[5]) and (g[1], g[3]) == (r[1], r[3]) and abs(g[5] - r[5]) <= 3000 and above(g[7], r[6]):
                want |= {x[0] for x in (g, r) if None not in x}
    flagged = A.flags(facts, key)
    assert {r["i"] for r in flagged.where("flags LIKE '%growth_ge_discount%'").collect()} == want and want
    assert "Join" not in plan(flagged) and flagged.count() == 400


def test_dates_of_odd_sentences(spark):
    said = ["discounted to March 31, 2020 and to 31 March 2021", "discounted as of February 30, 2021", "seen at May 3, 2021", "", None]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select(E.valuation_date(F.col("s"), F.lit(40)).alias("d"))
    assert [r["d"] for r in rows.collect()] == ["2021-03-31", "", "", "", ""]


def test_lexemes_are_handed_over_by_field():
    found = [L.lex("A fee of $1.5 million and discount rates of 9.0%, 10.0% and 11.0%."), [], L.lex("Lazard met UBS.")]
    assert L._arrow(found).equals(pa.array(found, pa.list_(L.LEXEME))) and L._arrow([[]]).type == pa.list_(L.LEXEME)

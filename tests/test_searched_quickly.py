"""Patterns that are sought in whole texts begin with one set of signs, and are only sought where their words are."""

import random
from re import _parser

from pyspark.sql import functions as F

from docfacts.operators import extraction as X
from docfacts.operators import lexing as L
from docfacts.operators import parties as P


def test_patterns_begin_with_a_set():
    names = L._names(["Evoqua Water Technologies", "Evoqua Water", "Evoqua"], ["Xylem", "ABN"])
    for pattern in (L.STOP, L.MARKED, names):
        assert str(_parser.parse(pattern.pattern)[0][0]) == "IN", pattern.pattern
    # signs that are no plain letters are sought as before
    assert [m.group() for m in L._names(["Élan Vital", "Élan"], ["Xylem"]).finditer("ÉLAN vital, élan, Élan; Xylem")] == ["ÉLAN vital", "Élan", "Xylem"]


def test_names_are_found_as_they_are_written():
    text = "Evoqua, evoqua water; EVOQUA WATER, evoqua. EVOQUA aEvoqua Evoquas ABN abn xylem XYLEM Xylem"
    found = L._names(["Evoqua Water", "Evoqua"], ["Xylem", "ABN"]).finditer(text)
    assert [(m.lastgroup, m.group()) for m in found] == [("filer", "Evoqua"), ("filer", "evoqua water"), ("filer", "EVOQUA WATER"), ("filer", "EVOQUA"), ("counter", "ABN"), ("counter", "XYLEM"), ("counter", "Xylem")]


def test_roles_are_sought_only_where_their_words_are(spark):
    issued, turned = "A vote on the ISSUANCE of shares of Evoqua. ", "EACH share of Evoqua is converted. "
    texts = [issued, issued + turned, issued + issued + turned, turned, "Nothing was said.", "", None, "Issue.", "Evoqua's issuance proposal"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.withColumn("role", P.filer_role(F.col("t"), F.array(F.lit("Evoqua"))))
    made = found._jdf.queryExecution().optimizedPlan().toString()
    assert made.index("issu)") < made.index("regexp_extract_all")
    assert [r["role"] for r in found.collect()] == ["acquirer", "target", "acquirer", "target", "target", "target", "target", "target", "acquirer"]


def test_companies_are_sought_without_a_group_at_first(spark):
    rows = spark.createDataFrame([("Class A Xylem Water Inc. Ordinary Shares. Big Old Bad Rare A common stock; O'Neill's shares, U.S. Foods stockholders", ["Evoqua"])], "t string, n array<string>")
    found = rows.select(P._spoken_of(F.col("t"), F.col("n")).alias("c"))
    assert found._jdf.queryExecution().optimizedPlan().toString().split("regexp_extract_all(")[1].split(", ")[1].startswith("[A-Z]")
    assert [c["name"] for c in found.first()["c"]] == ["A Xylem Water Inc.", "Big Old Bad Rare", "O'Neill", "U.S. Foods"]


def test_parties_next_to_no_value_change_nothing(spark, monkeypatch):
    draw = random.Random(8)
    bits = ["Parent", "the Company", "Buyer", "Evoqua", "evoqua water", "Xylem", "a discount rate of 9.0%", "exit multiples of 7.0x to 9.5x", "perpetuity growth rates of 1.0%, 2.0% and 3.0%", "a 4.0% perpetuity growth rate", "values per share of $5.00 to $6.00 implied", "pro forma", "Lazard", "a fee of $2.0 million", "Discounted Cash Flow Analysis"]
    text = lambda: "Opinion of Lazard\n" + "".join(draw.choice(bits) + draw.choice([" ", " ", ". The ", "\n", ", "]) for _ in range(40))
    docs = spark.createDataFrame([(i, "Xylem common stock. " * 7 + text() if i % 2 else text(), [(0, 17, 0.0, 0.0)], "Evoqua Water, Inc.") for i in range(150)], "k int, text string, lines array<struct<start:int,end:int,bold:double,linked:double>>, company string")
    made = lambda: [tuple(r) for r in X.extract(docs, "k", lines="lines", company="company").drop("n").collect()]
    thin = made()
    seen = []
    monkeypatch.setattr(X, "lexemes", lambda *a, thin, **more: seen.append(thin) or L.lexemes(*a, **more))
    assert sorted(map(str, made())) == sorted(map(str, thin)) and seen == [True] and len(thin) > 500
    kinds = [x["kind"] for x in L.thinned(L.lex("Parent and Buyer and Parent met Parent for 9.0%, then Buyer; Parent; Buyer at 8.0%. Buyer, Parent"))]
    assert kinds == ["counter", "counter", "pct", "counter", "counter", "pct", "counter", "counter"]

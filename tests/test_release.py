"""Verification of stored facts, and exact quantiles and ranks, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.operators import analytics as A
from docfacts.operators import verification as V
from docfacts.operators.quantiles import exact_quantiles, row_ranks

FACT = "fact_id string, accession string, field string, low double, high double, raw_low string, raw_high string, span_start int, span_end int, snippet_start int, snippet_end int, snippet string, doc_sha256 string"
TEXT = "Lazard used  a discount  rate of 9.5%,\nand é paid $3.25 per share."


def fact(i="f", accession="a", field="discount_rate", low=9.5, high=9.5, raw="9.5%", span="a discount  rate of 9.5%", text=TEXT, **more):
    at = text.index(span)
    row = {"fact_id": i, "accession": accession, "field": field, "low": low, "high": high, "raw_low": raw, "raw_high": raw, "span_start": at, "span_end": at + len(span), "snippet_start": 0, "snippet_end": len(text), "snippet": " ".join(text.split()), "doc_sha256": hashlib.sha256(text.encode()).hexdigest()} | more
    return tuple(row[c.split()[0]] for c in FACT.split(", "))


CASES = {
    "proven": (fact(), []), "offer": (fact(field="offer_price", low=3.25, high=3.25, raw="$3.25", span="$3.25"), []), "two amounts": (fact(field="value_per_share", low=3.25, high=4.0, raw="$3.25", span="$3.25"), ["value_not_reproduced"]),
    "other field": (fact(field="terminal_growth"), ["value_not_reproduced"]), "other value": (fact(low=9.4), ["value_not_reproduced"]), "cut value": (fact(span="a discount  rate of 9."), ["value_text_not_in_span", "value_not_reproduced"]),
    "no cue": (fact(span="9.5%"), ["value_not_reproduced"]), "reversed": (fact(span_end=3), ["span_out_of_range"]), "behind the end": (fact(span_end=len(TEXT) + 1, snippet_end=len(TEXT) + 1), ["span_out_of_range"]), "negative": (fact(span_start=-1), ["span_out_of_range"]),
    "null bounds": (fact(span_start=None), ["span_out_of_range"]), "null snippet": (fact(snippet=None), ["snippet_not_verbatim"]), "snippet starts late": (fact(snippet_start=20), ["snippet_does_not_contain_span"]), "snippet of other text": (fact(snippet_end=len(TEXT) - 1), ["snippet_not_verbatim"]),
    "no document": (fact(accession="b"), ["document_missing"]), "digest": (fact(accession="c", doc_sha256="0"), ["document_changed"]), "with it": (fact(accession="c"), ["document_changed"]), "null text": (fact(accession="d", doc_sha256=hashlib.sha256(b"").hexdigest()), ["span_out_of_range"]),
}


def test_verification_cases(spark):
    rows = [(name, *row[1:]) for name, (row, _) in CASES.items()]
    long = TEXT + "x" * 400
    rows += [rows[0], ("long", *fact(accession="e", text=long)[1:])]
    facts = spark.createDataFrame(rows, FACT).withColumn("text", F.lit("clash")).repartition(3)
    texts = spark.createDataFrame([("a", TEXT), ("c", TEXT), ("d", None), ("e", long)], "accession string, text string")
    out = V.verify_release(facts, texts)
    assert out.columns == [*facts.columns, "problems"]
    got = [(r["fact_id"], r["problems"]) for r in out.collect()]
    assert sorted(got) == sorted([*((n, p) for n, (_, p) in CASES.items()), ("proven", []), ("long", ["snippet_too_long"])])
    report = V.verification_report(out).first()
    assert (report["checked"], report["verified"], report["missing"], report["changed"], report["span_mismatch"], report["ok"]) == (20, 3, 1, 2, 14, False)
    none = V.verify_release(facts.limit(0), texts)
    assert none.count() == 0 and V.verification_report(none).first()["ok"] is False
    assert V.verification_report(out.where("fact_id = 'proven'")).first()["ok"] is True


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS verified LOCATION '{tmp_path}/db'")
    V.save_by_document(spark.createDataFrame([fact()], FACT), "verified.facts", 4)
    V.save_by_document(spark.createDataFrame([("a", TEXT)], "accession string, text string"), "verified.texts", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = V._cut(spark.table("verified.facts"), spark.table("verified.texts"))
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert V.verify_release(spark.table("verified.facts"), spark.table("verified.texts")).first()["problems"] == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE verified CASCADE")


VALUES = {
    "uniform": lambda r: r.random(), "ties": lambda r: float(r.randint(0, 3)), "two": lambda r: r.choice([0.0, -0.0, 1.0]), "wide": lambda r: r.choice([-1, 1]) * 10.0 ** r.randint(-200, 200), "odd": lambda r: r.choice([None, float("nan"), float("inf"), -2.5, r.random()]),
}


@pytest.mark.parametrize("name", VALUES)
def test_selection_equals_percentile(spark, name):
    rng = random.Random(name)
    rows = [(rng.choice([None, 1, 2, 2, 2]), VALUES[name](rng)) for _ in range(3000)] + [(3, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    p = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    clean = df.where("NOT isnan(v)")
    assert exact_quantiles(df, "v", p, limit=7, grid=16).first()["quantiles"] == clean.agg(F.percentile("v", p).alias("q")).first()["q"]
    want = {r["g"]: (r["n"], r["q"]) for r in df.select("g", F.when(~F.isnan("v"), F.col("v")).alias("v")).groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", p).alias("q")).collect()}
    got = {r["g"]: (r["n"], r["quantiles"] if r["n"] else None) for r in exact_quantiles(df, "v", p, ["g"], limit=5, grid=16).collect()}
    assert got == want


def test_no_task_reads_all_values(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 1000003 / 7.0).alias("v"))
    want = df.agg(F.percentile("v", [0.25, 0.5]).alias("q")).first()["q"]
    assert exact_quantiles(df, "v", [0.25, 0.5], limit=100).first()["quantiles"] == want


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert exact_quantiles(none, "v", [0.5]).first() == (0, [None])
    assert exact_quantiles(none, "v", [0.5], ["g"]).count() == 0
    stats = A.disagreement(spark.createDataFrame([], "deal_id string, abs_diff double")).first()
    assert stats["n_pairs"] == 0 and stats["median_pp"] is None


def test_ranks_and_steps(spark):
    rng = random.Random(3)
    values = [float(rng.randint(0, 40)) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(5)
    got = sorted((r["value"], r["step"]) for r in A.ecdf_steps(df, "v").collect())
    assert np.allclose(got, list(zip(sorted(values), (np.arange(1000) + 1) / 1000, strict=True)))
    assert row_ranks(df.limit(0), F.col("v")).count() == 0
    assert sorted(r["rank"] for r in row_ranks(df, F.col("v").desc()).collect()) == list(range(1, 1003))

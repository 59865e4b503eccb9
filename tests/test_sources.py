"""Readers and writers: what is written is read back, and odd rows have their stated results."""

import datetime as dt
import gzip
import hashlib

import numpy as np
from pyspark.sql import functions as F

from docfacts.operators import evaluation as E
from docfacts.sources import tables as S


def test_filings(spark, tmp_path):
    for name, body in (("a-1", b"x" * 1001), ("a-2", b"x" * 1000)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "main.htm.gz").write_bytes(gzip.compress(body))
    rows = S.read_filings(spark, str(tmp_path)).collect()
    assert [(r["accession"], r["filename"], len(r["html"])) for r in rows] == [("a-1", "main.htm", 1001)]


def test_hits(spark):
    page = '{"hits": {"hits": [{"_id": "a-1:b:c.htm", "_source": {"form": "X", "ciks": ["1"]}}, {"_id": "a-2", "_source": {}}]}}'
    rows = S.hits_from_json(spark.createDataFrame([(page,)], "value string")).orderBy("accession").collect()
    assert [(r["accession"], r["filename"], r["form"], r["file_date"], r["ciks"], r["names"]) for r in rows] == [("a-1", "b:c.htm", "X", "", ["1"], []), ("a-2", "", "", "", [], [])]


def test_catalog(spark, tmp_path):
    names = [c.split()[0] for c in S.CATALOG.split(", ")]
    rows = spark.createDataFrame([tuple(["A, B", "C"].copy() if n == "tickers" else f"{n} one" for n in names), tuple([] if n == "tickers" else f"{n} two" for n in names)], S.CATALOG.replace("tickers string", "tickers array<string>"))
    rows = rows.withColumn("tickers", F.transform("tickers", lambda t: F.regexp_replace(t, ", B", "")))
    S.write_catalog(rows, f"{tmp_path}/catalog")
    assert sorted(S.read_catalog(spark, f"{tmp_path}/catalog").collect()) == sorted(rows.collect())


def test_facts(spark, tmp_path):
    one = spark.range(3).selectExpr("cast(id as string) AS fact_id", "IF(id = 0, 'discount_rate', 'exit_multiple') AS field", "id + 0.5D AS low", "cast(id as int) AS year")
    S.write_facts(one, f"{tmp_path}/facts")
    back = S.read_facts(spark, f"{tmp_path}/facts").where("field = 'exit_multiple'")
    assert sorted((r["fact_id"], r["low"], r["year"]) for r in back.collect()) == [("1", 1.5, 1), ("2", 2.5, 2)]


def test_yields(spark, tmp_path):
    (tmp_path / "y.csv").write_text("date,value\n2020-01-02,1.88\n2020-01-03,.\nnone,2\n")
    assert [tuple(r) for r in S.read_yields(spark, f"{tmp_path}/y.csv").collect()] == [(dt.date(2020, 1, 2), 1.88)]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"accession": "a", "split": "dev"}, {"accession": "b", "split": "holdout"}]')
    assert [r["accession"] for r in S.read_manifest(spark, f"{tmp_path}/m.json", "holdout").collect()] == ["b"]


def test_labels(spark, tmp_path):
    good = "# note\n\ndiscount_rate|9|11|Lazard|dcf|T|-|2020-01-01|a | b#2\n"
    (tmp_path / "b.txt").write_text(good + "exit_multiple|x|1|-|dcf|T|-|-|q\nshort|1\nexit_multiple|1|2|-|none|T|-|-|q\n")
    (tmp_path / "a.txt").write_text(good)
    rows = S.read_labels(spark, str(tmp_path)).where("accession = 'b'").orderBy("line").collect()
    assert [(r["line"], r["problem"]) for r in rows] == [(3, None), (4, "number"), (5, "fields"), (6, "code")]
    assert (rows[0]["low"], rows[0]["subject"], rows[0]["metric"], rows[0]["quote"], rows[0]["occurrence"]) == (9.0, "target", "", "a | b", 2)
    want = hashlib.sha256()
    for name in ("a.txt", "b.txt"):
        want.update(name.encode() + b"\0" + (tmp_path / name).read_bytes() + b"\0")
    assert S.labels_digest(spark, str(tmp_path)).first()["digest"] == want.hexdigest()


def test_bootstrap_precision(spark):
    rng = np.random.default_rng(3)
    counts = [(f"a{i}", int(t), int(f)) for i, (t, f) in enumerate(zip(rng.integers(0, 9, 60), rng.integers(0, 4, 60), strict=True))]
    rows = [(a, "discount_rate", 1 if j < t else None, 1) for a, t, f in counts for j in range(t + f)] + [("a0", "fee_total", None, 1)]
    matches = spark.createDataFrame(rows, "accession string, field string, gold_id long, predicted_id long")
    filings = spark.createDataFrame([(a,) for a, _, _ in counts], "accession string")
    got = E.bootstrap_precision(matches, filings, draws=4000).first()
    tp, fp = np.array([c[1] for c in counts]), np.array([c[2] for c in counts])
    pick = rng.integers(0, 60, (4000, 60))
    want = np.quantile(tp[pick].sum(1) / (tp[pick] + fp[pick]).sum(1), [0.025, 0.975])
    assert abs(got["low"] - want[0]) < 0.01 and abs(got["high"] - want[1]) < 0.01
    none = E.bootstrap_precision(matches.where("false"), filings).first()
    assert none["low"] is None and none["high"] is None


def test_last_hit_wins_and_filings(spark):
    hit = '{"_id": "a-1:f", "_source": {"form": "X", "file_type": "X", "file_date": "%s", "ciks": ["0000007"], "display_names": %s, "sics": ["9"]}}'
    page = '{"hits": {"hits": [%s]}}'
    pages = [(page % hit % ("2020-09-09", "[]"), 2), (page % ", ".join([hit % ("2021-01-01", "[]"), hit % ("2020-01-01", '["Acme  Inc (ACM) (CIK 0000007)"]')]), 3), ("no json", 4)]
    hits = S.hits_from_json(spark.createDataFrame(pages, "value string, page int").repartition(3), page="page")
    found = S.discover(hits, "X")
    assert [r["file_date"] for r in found.collect()] == ["2020-01-01"]
    records = [('{"cik": "7", "name": "Acme Corp", "sic": "", "sicDescription": "Tools", "tickers": ["T", "U"]}',), ('{"cik": "7", "name": "Acme Aged"}',), ("[]",), (None,), ('{"name": "none"}',)]
    companies = S.companies_from_json(spark.createDataFrame(records, "value string"))
    assert [tuple(r) for r in companies.collect()] == [("7", "Acme Corp", "", "Tools", ["T", "U"])]
    made = S.filings_from_hits(found, companies).first().asDict()
    assert made == {"accession": "a-1", "filename": "f", "form": "X", "file_date": "2020-01-01", "cik": "0000007", "company": "Acme Inc", "sic": "9", "sic_description": "Tools", "tickers": ["T", "U"], "current_name": "Acme Corp"}
    bare = spark.createDataFrame([("a", "f", "X", "X", "2020", [], [], [])], found.schema)
    assert S.filings_from_hits(bare, companies).first().asDict() == {"accession": "a", "filename": "f", "form": "X", "file_date": "2020", "cik": "", "company": "", "sic": "", "sic_description": "", "tickers": [], "current_name": ""}


def test_attribute_accuracy(spark):
    gold = spark.createDataFrame([(1, "A", "x"), (2, "joint", "x"), (3, "", "y"), (4, "B", "")], "gold_id long, advisor string, metric string")
    predicted = spark.createDataFrame([(1, "A", "x"), (2, "C", "z"), (3, "D", "y"), (4, "C", "w")], "predicted_id long, advisor string, metric string")
    matches = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (None, 9), (9, None)], "gold_id long, predicted_id long")
    got = {r["attribute"]: (r["n"], r["accuracy"]) for r in E.attribute_accuracy(matches, gold, predicted, ["advisor", "metric"]).collect()}
    assert got == {"advisor": (2, 0.5), "metric": (3, 2 / 3)}

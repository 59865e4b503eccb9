"""Releases: published whole or not at all, and loaded as they were; the tree of results equals its analyses' rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from docfacts.operators import analytics as A
from docfacts.operators import results as T
from docfacts.sources import release as L
from docfacts.sources.tables import FACT_COLUMNS

NAMES = [c.split()[0] for c in FACT_COLUMNS.replace("\n", " ").split(", ")]


def facts(spark, n=6, mark="a"):
    kinds = dict(c.split() for c in FACT_COLUMNS.replace("\n", " ").split(", "))
    value = {"string": F.concat(F.lit(f'{mark}, "q" \\ \n'), F.col("id").cast("string")), "double": F.col("id") / 3, "int": F.col("id"), "long": F.col("id"), "boolean": F.col("id") % 2 == 0}
    made = spark.range(n).select(*[value[k].cast(k).alias(c) for c, k in reversed(kinds.items())], F.lit(1).alias("besides"))
    empty = F.col("fact_id").endswith("1")
    return made.withColumns({"metric": F.when(empty, "").otherwise(F.col("metric")), "flags": F.lit(""), "high": F.when(empty, F.lit(None)).otherwise(F.col("high")), "cik": F.lit("0012")})


def rows(df):
    return sorted(map(tuple, df.select(NAMES).collect()), key=str)


def test_release_is_read_back(spark, tmp_path):
    path = f"{tmp_path}/r"
    filings = spark.createDataFrame([("d", "a", "f", "x", "2020-01-01", "1", "c", "6021", "s", ["T", "U"], "n")], "deal_id string, accession string, filename string, form string, file_date string, cik string, company string, sic string, sic_description string, tickers array<string>, current_name string")
    name = L.publish(spark, path, facts(spark), filings)
    got = L.load(spark, path)
    assert got.columns == NAMES and len(NAMES) == 30
    assert rows(got) == rows(facts(spark))
    for at in (f"{path}/{L.RELEASES}/{name}/facts.csv", f"{path}/{L.RELEASES}/{name}/facts.parquet"):
        assert rows(L.load(spark, at)) == rows(facts(spark))
    assert L.load(spark, path, "filings").first()["tickers"] == "T,U"


def test_killed_writer_leaves_the_old_release(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/r"
    L.publish(spark, path, facts(spark, 3))
    broken = facts(spark, 50, "b").withColumn("low", F.when(F.col("span_start") > 40, F.raise_error(F.lit("killed"))).otherwise(F.col("low")))
    with pytest.raises(Exception, match="killed"):
        L.publish(spark, path, broken)
    assert rows(L.load(spark, path)) == rows(facts(spark, 3))
    with monkeypatch.context() as m:  # killed when all is written but the manifest
        m.setattr(L.Folder, "replace", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            L.publish(spark, path, facts(spark, 4, "c"))
    assert rows(L.load(spark, path)) == rows(facts(spark, 3))
    held = L.load(spark, path)
    last = L.publish(spark, path, facts(spark, 5, "d"))
    assert held.count() == 3 and rows(L.load(spark, path)) == rows(facts(spark, 5, "d"))
    gone = L.prune(spark, path)
    assert len(gone) == 3 and last not in gone and L.load(spark, path).count() == 5


def test_what_is_not_there(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="kind"):
        L.load(spark, str(tmp_path), "deals")
    for path in (f"{tmp_path}/none", str(tmp_path)):
        with pytest.raises(FileNotFoundError):
            L.load(spark, path)
    with pytest.raises(ValueError, match="lack"):
        L.publish(spark, f"{tmp_path}/r", facts(spark).drop("sic"))
    L.publish(spark, f"{tmp_path}/r", facts(spark, 0))
    assert L.load(spark, f"{tmp_path}/r").count() == 0
    with pytest.raises(FileNotFoundError):
        L.load(spark, f"{tmp_path}/r", "filings")
    monkeypatch.setenv(L.DATA, f"{tmp_path}/r")
    assert L.load(spark).columns == NAMES


def test_folders_without_manifest(spark, tmp_path):
    one = facts(spark, 4).select(NAMES)
    one.write.parquet(f"{tmp_path}/p/facts.parquet")
    one.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/c/facts.csv")
    assert rows(L.load(spark, f"{tmp_path}/p")) == rows(L.load(spark, f"{tmp_path}/c")) == rows(one)


FACTS = "deal_id string, accession string, field string, low double, high double, advisor string, subject string, analysis string, span_start long, filing_date date, year long, sic string, company string, flags string"


def test_tree_equals_its_analyses(spark):
    made = [(f"d{i % 10}", f"a{i % 10}", ["discount_rate", "terminal_growth", "exit_multiple", "implied_growth"][i % 4], 3.0 + i % 7, 3.0 + i % 11, ["X", "Y", "unattributed"][i % 3], "target", "dcf", 10 * i, f"{2010 + i % 3}-01-0{1 + i % 9}", 2010 + i % 3, "3500", f"Co {i % 10}", "a;b" if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(made, FACTS.replace("filing_date date", "filing_date string")).withColumn("filing_date", F.to_date("filing_date")).select(*[c.split()[0] for c in FACTS.split(", ")])
    filings = df.select("accession", "deal_id", F.col("filing_date").alias("file_date")).distinct()
    yields = spark.createDataFrame([("2009-01-01", 2.0), ("2010-06-01", 3.0), ("2011-06-01", 1.0)], "date string, dgs10 double").withColumn("date", F.to_date("date"))
    report = spark.range(1).select(F.lit(7).alias("checked"), F.lit(float("nan")).alias("share"), F.lit(1).alias("_private"))
    tree = json.loads(T.as_json(T.result_tree(df, filings, yields, 50, 3, "CO 4", verification=report)).first()["json"])
    assert tree["verification"] == {"checked": 7, "share": None} and tree["seed"] == 3 and tree["yields_last_observation"] == "2011-06-01"
    want = A.disagreement(A.pairwise_differences(A.advisor_values(df, "discount_rate"))).first().asDict()
    got = tree["analyses"]["bank_disagreement"]["discount_rate"]
    interval = got.pop("median_ci_95")
    assert got == pytest.approx(want) and interval[0] <= want["median_pp"] <= interval[1]
    rates = A.deal_rates(df, yields)
    years = [r.asDict() for r in A.market_by_year(rates).orderBy("year").collect()]
    assert tree["analyses"]["market_practice_by_year"] == [pytest.approx(y) for y in years]
    assert tree["analyses"]["advisor_table"] == [pytest.approx(r.asDict()) for r in A.advisor_table(df).orderBy(F.desc("deals"), "advisor").collect()]
    assert tree["corpus"]["soft_flag_counts"] == {"a": 64, "b": 64} and sum(tree["corpus"]["facts_by_field"].values()) == 80
    own = [m for m in made if m[0] == "d4"]
    assert tree["analyses"]["example"]["deal_id"] == "d4" and len(tree["analyses"]["example"]["facts"]) == len(own)
    assert not math.isnan(tree["analyses"]["implied_growth"]["share_covered"])


def test_tree_of_nothing(spark):
    df = spark.createDataFrame([], FACTS)
    filings = spark.createDataFrame([], "accession string, deal_id string, file_date date")
    tree = json.loads(T.as_json(T.result_tree(df, filings, spark.createDataFrame([], "date date, dgs10 double"), 10)).first()["json"])
    assert tree["corpus"]["n_facts"] == 0 and tree["corpus"]["facts_by_field"] == {} and tree["analyses"]["market_practice_by_year"] == []
    assert tree["analyses"]["bank_disagreement"]["terminal_growth"]["median_ci_95"] is None


def test_exhibits_of_nothing(spark):
    from docfacts.operators import exhibits as X

    bars = X.disagreement_bars(spark.createDataFrame([], "abs_diff double")).collect()
    assert len(bars) == 10 and {(r["n"], r["share_highlighted"]) for r in bars} == {(0, None)}
    assert X.implied_growth_steps(spark.createDataFrame([], "covered boolean, implied_high double")).count() == 0
    assert X.score_points(spark.createDataFrame([("dev", "x", 0, 0, 3)], "split string, field string, tp long, fp long, fn long")).select("metric", "value").collect() == [("recall", 0.0)]


def test_dominant_advisor(spark):
    from docfacts.operators.sections import dominant_advisor

    rows = [(1, "UBS and Lazard. Lazard left."), (2, "UBS and Lazard."), (3, None), (4, ""), (5, "UBS."), (5, "Lazard, Lazard.")]
    got = dominant_advisor(spark.createDataFrame(rows, "k long, text string"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "Lazard", 2), (2, "UBS", 1), (3, "unattributed", 0), (4, "unattributed", 0), (5, "Lazard", 2)]

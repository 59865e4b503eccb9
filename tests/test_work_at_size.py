"""Work that must not grow with the layout of the input or be done more than once: seen from plans and partitions."""

import re

from pyspark.sql import functions as F

from docfacts.operators import extraction as X
from docfacts.operators import parties as P
from docfacts.operators import sections as S
from docfacts.operators.lexing import lex
from docfacts.plans import release_queries as R
from docfacts.sources import release as L
from docfacts.sources.html import html_to_document


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_extraction(spark):
    found = plan(X.extract(spark.createDataFrame([(1, "")], "k long, text string"), "k"))
    assert len(re.findall(r"^\W*Window ", found, re.M)) <= 5
    # headings' words are one pattern, not a test of each
    kind = S.heading_kind(F.col("h"), F.lit(0.0))
    heads = spark.createDataFrame([("Opinions of Lazard",), ("The Background of the Merger",), ("Risk Factors",), ("U.S. Federal Income Tax Matters",), ("ux federal",)], "h string").withColumn("kind", kind)
    assert "exists(array(" not in plan(heads)
    assert [r["kind"] for r in heads.collect()] == ["opinion", "background", "end", "end", None]


def test_short_forms_end_no_sentence():
    at = [x["sentence"] for x in lex("A discount rate of Foo Inc. The discount rate. A discount rate of Foo Inc.\nDiscount rate")]
    assert at == [0, 0, 1, 2]


def test_conversion_uses_all_tasks(spark):
    pages = spark.range(100).coalesce(1).select("id", F.lit("<p>x</p>").alias("html"))
    n = html_to_document(pages, "html", "id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert n > 1


def test_a_text_is_searched_once_for_companies(spark):
    docs = spark.createDataFrame([(1, "Holders of Xylem common stock agree. " * 7, ["Evoqua"]), (2, None, ["Evoqua"])], "k long, text string, names array<string>")
    found = P.other_companies(docs, "text", "names", "k")
    assert plan(found).count("regexp_extract_all") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "Xylem", 7)]


def test_release_is_packed_and_distinct_before_it_grows(spark, sf, tmp_path):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    rows = plan(R._full(spark, sf))
    keys = rows[rows.index("Aggregate [") :].split("], [")[0]
    assert "accession" in keys and "doc_sha256" not in keys
    name = L.publish(spark, f"file://{tmp_path}/r", R._full(spark, sf).limit(5))
    files = [p.name for p in (tmp_path / "r" / L.RELEASES / name / "facts.csv").glob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert L.load(spark, f"file://{tmp_path}/r/{L.RELEASES}/{name}/facts.csv").count() == 5

"""Patterns that must be sought once for a row, not anew for every use of what they find."""

from pyspark.sql import functions as F

from docfacts.operators import extraction as X
from docfacts.operators import sections as S


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_cue_is_sought_once(spark):
    docs = spark.createDataFrame([(1, "It used discount rates of 9.0%, 10.0% and 11.0%; a 2.0% perpetuity growth rate.", [(0, 1, 0.0, 0.0)])], "k long, text string, lines array<struct<start:int,end:int,bold:double,linked:double>>")
    found = X.extract(docs, "k", lines="lines")
    made = plan(found)
    # the pattern before a cue, that of lists, and the form of a heading without its number
    assert [made.count(p) for p in (X.BEFORE_CUE, X.LISTED, r"^[\W_]*(?:[0-9]{1,2}[.)]\s+)?")] == [1, 1, 1]
    assert sorted((r["field"], r["low"]) for r in found.collect()) == [("discount_rate", 9.0), ("discount_rate", 10.0), ("discount_rate", 11.0), ("terminal_growth", 2.0)]


def test_a_headings_kind_is_the_same_by_column_and_by_steps(spark):
    heads = ["Opinions of Lazard", "3. The Background of the proposed Merger", "Background of the Board", "Risk Factors", "risk factors", "Evercore’s Fairness Opinion", "Opinion of Counsel", "Opinion of Lazard | 7", "  ", None]
    rows = spark.createDataFrame([(h, x) for h in heads for x in (0.0, 1.0)], "h string, linked double")
    found = S.with_heading_kind(rows.withColumn("kind", S.heading_kind(F.col("h"), F.col("linked"))), "stepped", F.col("h"), F.col("linked"))
    kinds = found.collect()
    assert all(r["kind"] == r["stepped"] for r in kinds)
    assert [r["kind"] for r in kinds if r["linked"] == 0] == ["opinion", "background", None, "end", None, "opinion", None, None, None, None]

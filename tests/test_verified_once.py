"""Stored facts are verified with one reading of each span, and one digest of each document."""

from pyspark.sql import functions as F

from docfacts.operators import verification as V


def release(spark, n):
    said = "discount rates ranging from 9.0% to 11.0%"
    texts = spark.range(n).select(F.concat(F.lit("a"), "id").alias("accession"), F.lit(f"Lazard used {said}. $5 million.").alias("text"))
    facts = texts.select(
        F.concat("accession", F.lit(":1")).alias("fact_id"), "accession", F.lit("discount_rate").alias("field"), F.lit(9.0).alias("low"), F.lit(11.0).alias("high"), F.lit("9.0%").alias("raw_low"), F.lit("11.0%").alias("raw_high"),
        F.lit(12).alias("span_start"), F.lit(12 + len(said)).alias("span_end"), F.lit(0).alias("snippet_start"), F.length("text").alias("snippet_end"), F.col("text").alias("snippet"), F.sha2("text", 256).alias("doc_sha256"),
    )
    return facts, texts


def test_equal_spans_are_read_once_in_each_part(spark):
    facts, texts = release(spark, 400)
    # repeated facts, also of no name, and one whose value its span does not state
    nameless, wrong = facts.limit(3).withColumn("fact_id", F.lit(None).cast("string")), facts.limit(1).withColumn("high", F.lit(12.0))
    out = V.verify_release(facts.unionByName(facts.limit(5)).unionByName(nameless).unionByName(wrong), texts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(map(tuple, out.groupBy(F.array_join("problems", ";")).count().collect())) == [("", 408), ("value_not_reproduced", 1)]


def test_a_documents_digest_is_made_before_its_facts_join(spark):
    facts, texts = release(spark, 4)
    plan = V._cut(facts, texts.withColumn("text", F.concat("text", F.lit("")))).drop("__there")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join LeftOuter")
    assert "__digest" in plan[joined:] and "sha2(" not in plan[:joined]

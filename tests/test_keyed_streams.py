"""Keyed state over streams: any split into batches gives the batch operators' results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docfacts.operators import relational as R
from docfacts.streaming import keyed as K

SCHEMA = "deal string, field string, accession string, filed date, span int, value double"


def rows(n=160, seed=4):
    rng = random.Random(seed)
    day = lambda: dt.date(2015, 1, 1) + dt.timedelta(days=rng.randint(0, 2500))
    made = [(rng.choice(["a", "b", None, "c"]), rng.choice(["x", "y"]), rng.choice(["1", "2", "3", None]), rng.choice([day(), None]), i, rng.random()) for i in range(n)]
    return made + made[:5]


def parts(tmp_path, spark, split, made):
    """Writes the rows as files of ``split`` batches, in a random order."""
    rng = random.Random(split)
    rng.shuffle(made)
    for b in range(split):
        spark.createDataFrame(made[b::split], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("split", [1, 4])
def test_first_filings_equal_the_batch_operator(spark, tmp_path, split):
    made, key, order = rows(), ["deal", "field"], ["filed", "accession", "span"]
    stream = parts(tmp_path, spark, split, made)
    got = K.run_available(spark, K.first_filings(stream, key, order), f"{tmp_path}/out", f"{tmp_path}/check", key)
    want = R.keep_first(spark.createDataFrame(made, SCHEMA), key, order, "accession", "n_filings")
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_later_files_go_on_from_the_state(spark, tmp_path):
    made, key, order = rows(60), ["deal", "field"], ["filed", "accession", "span"]
    run = lambda s: K.run_available(spark, K.first_filings(s, key, order), f"{tmp_path}/out", f"{tmp_path}/check", key)
    run(parts(tmp_path, spark, 1, made[:30]))
    got = run(parts(tmp_path, spark, 1, made[30:]))
    want = R.keep_first(spark.createDataFrame(made, SCHEMA), key, order, "accession", "n_filings")
    assert sorted(map(str, got.select("deal", "field", "span", "n_filings").collect())) == sorted(map(str, want.select("deal", "field", "span", "n_filings").collect()))


@pytest.mark.parametrize("split", [1, 5])
def test_sessions_equal_the_batch_operator(spark, tmp_path, split):
    made = rows()
    changes = K.sessions(parts(tmp_path, spark, split, made), "deal", "filed", "span", 60)
    got = K.run_available(spark, changes, f"{tmp_path}/out", f"{tmp_path}/check", ["key"])
    batch = R.sessions(spark.createDataFrame(made, SCHEMA), "deal", "filed", 60, "session").where("filed IS NOT NULL")
    want = batch.groupBy(F.col("deal").alias("key"), F.col("session").cast("long").alias("session")).agg(F.min("filed").alias("first_date"), F.max("filed").alias("last_date"), F.min(F.struct("filed", F.col("span").cast("string").alias("i")))["i"].alias("first_id"), F.count("*").alias("n"))
    columns = ["key", "session", "first_date", "last_date", "first_id", "n"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    with pytest.raises(ValueError, match="positive"):
        K.sessions(batch, "deal", "filed", "span", 0)


def test_no_rows(spark, tmp_path):
    changes = K.sessions(parts(tmp_path, spark, 1, []), "deal", "filed", "span", 60)
    assert K.run_available(spark, changes, f"{tmp_path}/out", f"{tmp_path}/check", ["key"]).count() == 0

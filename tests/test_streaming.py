from docfacts.streaming.ingest import ingest


def test_ingest_reads_each_filing_once(spark, tmp_path):
    say = lambda n: f"<h2>Opinion of the Financial Advisor</h2><p>Lazard performed a discounted cash flow analysis with discount rates of {n}.0% to {n + 1}.0%.</p>"
    schema, source, out = "accession string, html string", str(tmp_path / "in"), str(tmp_path / "out")
    for run in (1, 2):
        spark.createDataFrame([(f"a{run}", say(8 + run)), (None, None), (f"b{run}", None)], schema).write.mode("append").parquet(source)
        ingest(spark, source, schema, out, str(tmp_path / "at")).awaitTermination()
    rows = {r["accession"]: (r["low"], r["high"], r["advisor"], r["reason"]) for r in spark.read.parquet(out).collect()}
    assert rows == {"a1": (9.0, 10.0, "Lazard", None), "a2": (10.0, 11.0, "Lazard", None)}

"""What is stored is not written again for the tree of results."""

from docfacts.operators import results as T
from docfacts.operators.durable import written
from docfacts.operators import analytics as A


def test_stored_tables_are_not_written_again(spark, monkeypatch):
    pairs = spark.createDataFrame([("D1", 1.0), ("D2", 3.0)], "deal_id string, abs_diff double")
    names = []
    monkeypatch.setattr(A, "written", lambda df, name="cut": names.append(name) or written(df, name))
    monkeypatch.setattr(T, "written", lambda df, name="cut": names.append(name) or written(df, name))
    monkeypatch.setattr(A, "pairwise_differences", lambda values: pairs)
    facts = spark.createDataFrame([("D1", "S1", "discount_rate", "target", "dcf", 1.0, 2.0)], "deal_id string, advisor string, field string, subject string, analysis string, low double, high double")
    row = T.disagreement(facts, "discount_rate", 20, 0).first()
    assert (row["n_pairs"], row["median_pp"], row["max_pp"]) == (2, 2.0, 3.0)
    assert names.count("pairs") == 1

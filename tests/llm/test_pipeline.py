"""The pipeline runs whole, keeps its columns, drops what its stages reject and meets odd rows; small stages against brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as C

#: Columns that are called as operators call their own.
CLASHING = {
    "score": "x", "f": "y", "pii": "p", "first.name": 3, "gone": 1, "_gone": 9, "component": 2, "id": "i", "row": 8, "parts": 5, "t": 4, "kept": "k",
    "__a": "z", "__f": 1, "__score": 0.7, "__parts": 2, "__pii": "q", "__gone": 6, "__row": 7, "__stat": 1.0, "__stat_t": "t", "__stat_n_chars": 0.5,
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf))
        assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before > 0


def odd_rows(spark, sf):
    """Rows of the documents with nulls, empty, repeated and very long texts, and columns whose names operators use."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    long = " ".join(f"word{i} of the long text" for i in range(60_000))
    rows = [(None, "some text of a row without an id", "en", "s", 5), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, long, "en", "s", len(long)), (-4, "twice the same text here", "en", "s", 1), (-4, "twice the same text here", "en", "s", 1), (-5, "mail a@b.cc", None, "s", None)]
    odd = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    return odd.withColumns({c: F.lit(v) for c, v in CLASHING.items()} | {"y": F.col("doc_id")})


def test_odd_rows_pass_every_stage(spark, sf):
    docs = written(spark, odd_rows(spark, sf))
    names, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = written(spark, stage(spark, given, sf))
            assert out.columns == names, name
            rows = out.collect()
            assert {r["doc_id"] for r in rows} <= ids and all(r[c] == v for r in rows for c, v in CLASHING.items()), name
            if given is not docs:
                assert not rows
            elif name in ("near_dedup", "pii", "toxicity"):
                assert {None, -1, -2, -3, -4, -5} <= {r["doc_id"] for r in rows}, name
    once = C.near_dedup(spark, docs, sf).where("doc_id = -4").count()
    assert once == 1 and C.near_dedup(spark, docs, sf).where("doc_id IS NULL").count() == 1
    made = {r["doc_id"]: r for r in C.pii(spark, docs, sf).where("doc_id < 0").collect()}
    assert made[-1]["text"] is None and made[-1]["n_chars"] is None and "a@b.cc" not in made[-5]["text"] and made[-5]["n_chars"] == len(made[-5]["text"])
    packed = C.packing(spark, docs, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids and C.packing(spark, docs.limit(0), sf).count() == 0


def test_stages_equal_brute_force(spark, sf):
    """Near-duplicates by all pairs; filters keep exactly what the operators' scores say; pseudonyms change nothing else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t).encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    own = {i: i for i in rows}
    find = lambda x: x if own[x] == x else find(own[x])
    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                own[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in C.near_dedup(spark, docs, sf).collect()} == {i for i in ids if find(i) == i}
    from docfacts.llm.quality import QualityModel
    from docfacts.llm.toxicity import ToxicityModel

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for stage, model, keep in ((C.toxicity, ToxicityModel, lambda s: s < 0.5), (C.quality, QualityModel, lambda s: s >= 0.5)):
        scores = {r["doc_id"]: r["score"] for r in model.fit(docs, labels).score(docs, "doc_id").collect()}
        assert {r["doc_id"] for r in stage(spark, docs, sf).collect()} == {i for i, s in scores.items() if keep(s)}

"""Near-duplicates, neighbours and archives against brute force."""

import base64
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docfacts.llm import embed_dedup, minhash, vptree, warc
from docfacts.llm._common import Scratch, components


def smallest(n, links):
    own = dict.fromkeys(n)
    for x in own:
        own[x] = x
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(own[a], own[b])
            if own[a] != low or own[b] != low:
                own[a] = own[b] = low
                changed = True
    return own


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)] + [(5000, 5001 + i) for i in range(200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = smallest({x for p in links for x in p}, links)
    assert all(got.get(x, x) == c for x, c in want.items())


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows = []
    for base in range(12):
        words = [word() for _ in range(120)]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [rows[0]] * 40 + ["", None, "one", "ONE", "two words", "two words", " \t\n", "éa Éa", "x " * 3000]
    return list(enumerate(rows))


def test_minhash(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAMILY", 5)  # families of several blocks
    monkeypatch.setattr(minhash, "SHINGLES", 400)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "one", 1)], "doc_id long, text string, id int")
    for k in (2, 5):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, docs, k).collect()}
        sets = {}
        for i, t in rows:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = smallest(sets, links)
        assert all(got[i]["component_id"] == want[i] and got[i]["n_shingles"] == len(sets[i]) for i in sets)
        assert got[None]["component_id"] is None and got[None]["kept"]
        kept = {r["doc_id"] for r in minhash.keep_one(spark, docs, k).collect()}
        assert kept == {i for i in want if want[i] == i} | {None}
    assert minhash.near_duplicates(spark, docs.limit(0)).count() == 0


def vectors(n=400):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 16))
    x[50:120] = x[0] + 0.05 * rng.standard_normal((70, 16))
    x[200:230] = x[7]
    rows = [(i, v.tolist(), int(i % 2) if i < 300 else 0) for i, v in enumerate(x)]
    return x, rows + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None], 0), (n + 4, [1.0] * 16, None), (n + 5, [], 0), (None, x[0].tolist(), 0)]


def test_embedding_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "DENSE", 16)
    x, rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r["vec_id"]: r for r in embed_dedup.embedding_near_duplicates(spark, df).collect()}
    x = np.array([r[1] for r in rows[:400]], dtype=np.float32).astype(float)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:400]])
    hit = (y @ y.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    want = smallest(range(400), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)])
    assert all(got[i]["n_links"] == hit[i].sum() and got[i]["component_id"] == want[i] for i in range(400))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(400, 406)) and got[None]["kept"]
    assert embed_dedup.embedding_near_duplicates(spark, df.limit(0)).count() == 0


def leaning(n, dims, mean, pairs, seed=3):
    """Unit vectors with a shared direction, and planted pairs with cosines of 0.931 to 0.97."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal(dims)
    y = embed_dedup.unit(np.sqrt(mean) * m / np.linalg.norm(m) + np.sqrt(1 - mean) * rng.standard_normal((n, dims)) / np.sqrt(dims))
    for i in range(pairs):
        r = rng.standard_normal(dims)
        r -= r @ y[2 * i] * y[2 * i]
        c = rng.uniform(0.931, 0.97)
        y[2 * i + 1] = c * y[2 * i] + np.sqrt(1 - c * c) * r / np.linalg.norm(r)
    return y[rng.permutation(n)]


@pytest.mark.parametrize(("n", "mean", "whole"), [(20_000, 0.9, True), (6000, 0.6, False), (6000, 0.0, False)])
def test_links_of_leaning_vectors(spark, n, mean, whole):
    y = leaning(n, 32, mean, 300)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": [v.tolist() for v in y], "label": 1}), "vec_id long, embedding array<double>, label int")
    # labels are compared whole only where that is asked for
    rows = embed_dedup.embedding_near_duplicates(spark, df, whole=1.25 if whole else None).toPandas().set_index("vec_id").sort_index()
    y = embed_dedup.unit(y)
    links = np.zeros(n, dtype=int)
    for s in range(0, n, 1000):
        links[s : s + 1000] = (y[s : s + 1000] @ y.T >= 0.93).sum(axis=1) - 1
    assert (rows["n_links"].to_numpy() == links).mean() > (0.9999 if whole else 0.999)
    assert rows["n_links"].sum() >= 0.99 * links.sum() > 0
    plan = embed_dedup.Plan.measure(df.selectExpr("vec_id AS id", "CAST(label AS bigint) AS label", "size(embedding) AS dims", "embedding"), 0.93, whole=1.25 if whole else None)
    assert (plan.of(1, 32)[1] == 0) == whole


@pytest.mark.parametrize(("n", "mean"), [(50, 0.0), (218, 0.0), (1200, 0.3)])
def test_windows_decide_the_links_of_small_labels(spark, monkeypatch, n, mean):
    """Labels larger than a window are linked by passes, not by comparing all their vectors."""

    def never(cosine):
        raise AssertionError("compared whole")

    monkeypatch.setattr(embed_dedup, "_whole", never)
    y = leaning(n, 64, mean, n // 10, seed=n)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.repeat(y, 2, axis=0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed_dedup.embedding_near_duplicates(spark, df).toPandas().set_index("vec_id").sort_index()["n_links"].to_numpy()
    assert n > embed_dedup.WINDOW and (got[::2] == (y @ y.T >= 0.93).sum(axis=1) - 1).all() and (got[::2] == got[1::2]).all()


def test_windows_that_overflow(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.standard_normal(16) + 0.02 * rng.standard_normal((1500, 16)), rng.standard_normal((500, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows = embed_dedup.embedding_near_duplicates(spark, df, passes=3).orderBy("vec_id").collect()
    assert all(r["n_links"] == 1499 and r["component_id"] == 0 for r in rows[:1500]) and not any(r["n_links"] for r in rows[1500:])


def nearest_by_force(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return out


def nearest_found(spark, df, **more):
    found = {}
    for r in sorted(vptree.nearest(spark, df, F.col("vec_id") % 20 == 0, **more).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 90 * 16 * 8)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 7)
    _, rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    ids = np.array([*range(400), 404])
    x = np.array([rows[i][1] for i in ids], dtype=np.float32).astype(float)
    assert nearest_found(spark, df) == nearest_by_force(ids, x, 20)
    assert vptree.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert nearest_found(spark, few) == {0: [(1, 5.0), (20, 5.0)], 20: [(0, 5.0), (1, 5.0)]}


@pytest.mark.parametrize("kind", ["integers", "norms", "one giant", "copies"])
def test_nearest_is_exact_on_hard_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 300 * 12 * 8)
    monkeypatch.setattr(vptree, "HELD", 3000)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 12))
    if kind == "integers":
        x = rng.integers(0, 3, (2000, 12)).astype(float)
    elif kind == "norms":
        x *= 10 ** rng.uniform(0, 9, (2000, 1))
    elif kind == "one giant":
        x[7] *= 4e9
    else:
        x[:700] = x[0]
        x[700:1400] = x[700 + np.arange(700) % 7]
    ids = np.arange(2000)[(x != 0).any(axis=1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert nearest_found(spark, df) == nearest_by_force(ids, x[ids], 20)


def test_relaxed_search_visits_less_and_keeps_most(spark):
    rng = np.random.default_rng(6)
    c = rng.standard_normal((40, 32))
    x = c[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 32))
    visits, recall = [], []
    for relax in (1.0, 0.8, 0.5):
        tree = vptree.VPTree.build(x, leaf=32)
        got = [set() for _ in range(200)]
        for w, p in tree.search(x[:200], 20, relax=relax):
            for a, b in zip(w.tolist(), p.tolist(), strict=True):
                got[a].add(b)
        want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :21]
        recall.append(np.mean([len(got[i] & set(want[i].tolist())) / 21 for i in range(200)]))
        visits.append(tree.visited)
    assert recall[0] == 1.0 and recall[1] > 0.98 and visits[0] > visits[1] > visits[2]


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").limit(60)
    odd = [(-5, "http://é.x/ a\n?b", "dup\r\n\r\n"), (-4, "http://x.y/", "dup\r\n\r\n"), (None, None, "dup\r\n\r\n"), (-3, None, None), (-2, "z", ""), (-2, "z", "")]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    rows, first = pages.collect(), {}
    for r in rows:
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(first.get(r["html"] or "", r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        body = (r["html"] or "").encode()
        again = r["page_id"] is not None and first[r["html"] or ""] != r["page_id"]
        want.append((r["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[r["html"] or ""] if again else None))
    got = [tuple(r) for r in warc.warc_round_trip(spark, pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0

"""Greedy matches, quotes and source offsets against their plain forms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docfacts.operators import evaluation as E
from docfacts.sources.html import html_offset, html_offsets, html_to_document

SIDE = "accession string, field string, low double, high double, span_start long, span_end long, "


def plain(gold, predicted):
    """Each label takes the first free prediction, by looking at all of them."""
    used, out = set(), []
    for a, f, low, high, s, e, i in sorted(gold, key=lambda r: r[-1]):
        for q in sorted(predicted, key=lambda r: r[-1]):
            near = abs(q[2] - low) <= 1e-9 and abs(q[3] - high) <= 1e-9
            if (q[0], q[6]) not in used and q[:2] == (a, f) and near and (f == "offer_price" or (q[4] < e and s < q[5])):
                used.add((q[0], q[6]))
                out.append((a, f, i, q[6]))
                break
        else:
            out.append((a, f, i, None))
    return sorted(map(str, out + [(q[0], q[1], None, q[6]) for q in predicted if (q[0], q[6]) not in used]))


@pytest.mark.parametrize("seed", range(3))
def test_match_equals_looking_at_all(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([1.0, 2.0, 2.0, 1e8, 0.0, 2e-9]) + rng.choice([0, 0, 4e-10, -4e-10, 1e-9, 3e-9])

    def rows(n):
        made = []
        for i in range(n):
            start = rng.randint(0, 60)
            made.append((rng.choice(["a", "b"]), rng.choice(["offer_price", "x", "x"]), value(), rng.choice([2.0, 2.0 + 8e-10]), start, start + rng.randint(0, 9), i))
        rng.shuffle(made)
        return made

    gold, predicted = rows(150), rows(170)
    got = E.match(spark.createDataFrame(gold, SIDE + "gold_id long"), spark.createDataFrame(predicted, SIDE + "predicted_id long"))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(gold, predicted)


def test_very_many_equal_values_of_one_document():
    n = 100_000
    rows = [(i, "x", 5.0, 5.0, 10 * i, 10 * i + 5) for i in range(n)]
    began = time.time()
    assert E.greedy(rows, rows) == [("x", i, i) for i in range(n)]
    # labels from the last to the first place, and prices, which take them in order
    turned = [(i, "x", 5.0, 5.0, 10 * (n - 1 - i), 10 * (n - 1 - i) + 5) for i in range(n)]
    assert E.greedy(turned, rows) == [("x", i, n - 1 - i) for i in range(n)]
    prices = [(i, "offer_price", 5.0, 5.0, 0, 0) for i in range(n)]
    assert E.greedy(prices, prices) == [("offer_price", i, i) for i in range(n)]
    assert time.time() - began < 60


def test_match_of_odd_rows(spark):
    none = spark.createDataFrame([], SIDE + "gold_id long")
    one = spark.createDataFrame([("a", "x", None, 1.0, 0, 5, 1), ("a", "x", float("nan"), 1.0, 0, 5, 2), ("a", "x", 1.0, 1.0, None, 5, 3), (None, "x", 1.0, 1.0, 0, 5, 4)], SIDE + "gold_id long")
    other = one.withColumnRenamed("gold_id", "predicted_id")
    assert E.match(none, other.limit(0)).count() == 0
    assert {(r["gold_id"], r["predicted_id"]) for r in E.match(one, other).collect()} == {(1, None), (2, None), (3, None), (4, 4), (None, 1), (None, 2), (None, 3)}


def test_quotes_equal_plain_search(spark):
    rng = random.Random(1)
    texts = {f"t{i}": "".join(rng.choice(["ab ", "a", "b\n", "\t", " ", "a.b", "\\E", "(", "é ", "\x1c"]) for _ in range(rng.randint(0, 60))) for i in range(60)} | {"null": None, "blank": " \n "}
    rows = []
    for i, (a, t) in enumerate(texts.items()):
        at = rng.randint(0, max(0, len(t or "") - 1))
        quote = " \n".join((t or "x")[at : at + rng.randint(1, 9)].split(" ")) if i % 9 else rng.choice([None, "", "  ", "zzz", "a"])
        rows += [(a, quote, k, 1) for k in (None, 0, 1, 2, 7)]
    df = spark.createDataFrame(rows, "accession string, quote string, occurrence int, text int")
    found = E.locate_quotes(df, spark.createDataFrame(list(texts.items()), "accession string, text string"))
    assert found.columns == ["accession", "quote", "occurrence", "text", "matches", "start", "end"]
    assert found.count() == len(rows)
    for r in found.collect():
        t, q = texts[r["accession"]], r["quote"]
        hits = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, q.split())), t)] if t and q and q.split() else []
        k = r["occurrence"] if r["occurrence"] is not None else 1 if len(hits) == 1 else None
        want = hits[k - 1] if k and 1 <= k <= len(hits) else (None, None)
        assert (r["matches"], (r["start"], r["end"])) == (len(hits), want), r


def test_offsets_in_bulk_equal_single_ones(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    docs = html_to_document(pages, "html", "page_id").withColumn("rank", F.lit(1)).persist()
    at = docs.select("page_id", F.explode(F.sequence(F.lit(0), F.length("text") + 1, F.lit(7))).alias("position"))
    at = at.unionByName(at.limit(3)).unionByName(spark.createDataFrame([(None, 1), (-5, 1)], "page_id long, position int")).withColumn("name", F.lit("kept"))
    got = html_offsets(at, docs, "page_id")
    assert got.columns == ["page_id", "position", "name", "html_pos"]
    slow = at.join(docs, "page_id", "left").withColumn("html_pos", html_offset(F.coalesce("runs", F.array().cast("array<struct<text_pos:int,html_pos:int,len:int>>")), F.col("position")))
    assert sorted(map(str, got.collect())) == sorted(map(str, slow.select(got.columns).collect()))
    # where a place has a source, the characters are the same, but for entities and white space
    text, html = docs.select("page_id", "text"), pages.select("page_id", "html")
    both = got.where("html_pos IS NOT NULL").join(text, "page_id").join(html, "page_id").select(F.substr("text", F.col("position") + 1, F.lit(1)).alias("t"), F.substr("html", F.col("html_pos") + 1, F.lit(1)).alias("h"))
    letters = both.where(F.col("t").rlike("[A-Za-z]") & (F.col("h") != "&"))
    assert letters.count() > 100 and letters.where("t <> h").count() == 0

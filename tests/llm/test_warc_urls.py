"""No page is lost, whatever its url."""

import sys
import unicodedata

import pytest

from docfacts.llm import warc


def test_urls_with_any_white_space(spark):
    blank = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc")]
    urls = [None, "", " ", "\t", ":", "://", "http://", "no scheme", "http://A.example.org/%20 %\t%", "http://a/" + "x" * 100_000, "http://a/b:c", "http://a/b\r\nWARC-Date: x"]
    for c in blank:
        urls += [f"http://a.org/b{c}", f"{c}http://a.org/b", f"http://a.org/b{c}c", f"http://a{c}.org{c}/b", c, c * 3]
    rows = [(i, u, f"<p>{i % 50}</p>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.warc_round_trip(spark, pages).collect()
    assert sorted(r["page_id"] for r in out) == list(range(len(urls)))
    assert {r["page_id"]: r["refers_to"] for r in out} == {i: i % 50 if i >= 50 else None for i in range(len(urls))}


def test_a_page_that_is_not_found_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.org/b", "x"), (2, "http://a.org/c", "y")], "page_id long, url string, html string")
    lookup = warc.CaptureIndex.lookup
    monkeypatch.setattr(warc.CaptureIndex, "lookup", lambda self, wanted: lookup(self, wanted.limit(1)))
    with pytest.raises(ValueError, match="2 pages"):
        warc.warc_round_trip(spark, pages)

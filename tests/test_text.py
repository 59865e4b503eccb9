"""Text operators on single sentences and documents."""

import pytest
from pyspark.sql import functions as F

from docfacts.operators import extraction as X
from docfacts.operators.lexing import lexemes, parse_number
from docfacts.sources.html import convert, html_offset, html_to_document

CASES = [
    ("discount rates ranging from 9.0% to 11.0%", [("discount_rate", 9.0, 11.0)]),
    ("a discount rate of 10.5 percent", [("discount_rate", 10.5, 10.5)]),
    ("a WACC of 9.0 – 11.0%", [("discount_rate", 9.0, 11.0)]),
    ("a cost of equity between 8.5% and 9.5%", [("discount_rate", 8.5, 9.5)]),
    ("11.0% discount rate and 3.5% perpetuity growth", [("discount_rate", 11.0, 11.0), ("terminal_growth", 3.5, 3.5)]),
    ("10.0% to 14.0% discount rates", [("discount_rate", 10.0, 14.0)]),
    ("a perpetuity growth rate of (1.5)%", [("terminal_growth", -1.5, -1.5)]),
    ("terminal growth rates of negative 1.0% to 2.0%", [("terminal_growth", -1.0, 2.0)]),
    ("a 3.25% terminal growth rate", [("terminal_growth", 3.25, 3.25)]),
    ("exit multiples of 9.5x to 10.5x, 8.0x to 9.0x and 7.0x to 8.0x", [("exit_multiple", 9.5, 10.5), ("exit_multiple", 8.0, 9.0), ("exit_multiple", 7.0, 8.0)]),
    ("implied perpetuity growth rates of 2.0% to 3.0%", [("implied_growth", 2.0, 3.0)]),
    ("a Federal Reserve discount rate of 4.0%", []),
    ("discount rates (9 to 11) and nothing more", []),
    ("", []),
]


def test_candidates(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "k long, text string")
    rows = X.candidates(lexemes(docs, "text", "k"), "k").orderBy("k", "n").collect()
    for i, (text, want) in enumerate(CASES):
        assert [(r["field"], r["low"], r["high"]) for r in rows if r["k"] == i] == want, text
    assert not [r for r in rows if r["k"] == 99]


def test_numbers():
    assert parse_number("$1,200.50") == 1200.5
    assert parse_number("(1.0)%") == -1 and parse_number("negative 1.5 percent") == -1.5 and parse_number("$2.5 million") == 2.5e6
    with pytest.raises(ValueError):
        parse_number("none")


def test_html():
    text, lines, _ = convert("<head><title>x</title></head><p>A&nbsp;b &amp; <b>c</b></p><table><tr><td>1</td><td>2 </td></tr></table><p>ranging</p><p>101</p><p>from 9&#150;10%</p><script>no</script>")
    assert text == "A b & c\n1 | 2\nranging from 9–10%\n"
    assert [text[x["start"] : x["end"]] for x in lines] == ["A b & c", "1 | 2", "ranging from 9–10%"]


def test_html_offsets(spark):
    source = "<p>x &lt;y&gt; <i>zebra</i></p>"
    docs = html_to_document(spark.createDataFrame([(1, source), (2, None), (3, "")], "k long, html string"), "html", "k")
    rows = {r["k"]: r for r in docs.withColumn("at", html_offset(F.col("runs"), F.instr("text", F.lit("zebra")) - 1)).collect()}
    assert source[rows[1]["at"] :].startswith("zebra") and rows[2]["text"] == "\n" and rows[3]["lines"] == []

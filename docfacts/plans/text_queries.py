"""Queries of the text operators.

The driver's texts state no valuations, so sentences are rendered from numeric columns, read by the real operators, and
the SQL states the numbers straight from the columns: a round trip with an independent answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import finalize as Z
from ..operators import parties as P
from ..operators import sections as S
from ..operators.lexing import dealt, lexemes
from ..sources.html import html_offset, html_to_document
from .queries import QUERIES, add

# One order is one document; the numbers it states, for the texts and for the SQL.
NUMBERS = """
d AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'Lazard' WHEN 1 THEN 'Goldman Sachs' ELSE 'Evercore' END AS house, 5 + (o_orderkey % 90) / 10.0::DOUBLE AS a, 5 + (o_orderkey % 90) / 10.0::DOUBLE + (o_custkey % 30) / 10.0::DOUBLE AS b,
  1 + (o_custkey % 25) / 10.0::DOUBLE AS g, 6 + o_orderkey % 9 AS m, o_orderkey % 7 = 0 AS wild, o_orderkey % 5 = 0 AS unnamed, o_custkey % 40 + 1 AS fee FROM orders)
"""


def _documents(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.when(c % 3 == 0, "Lazard").when(c % 3 == 1, "Goldman Sachs").otherwise("Evercore").alias("house"),
        (5 + (k % 90) / 10).alias("a"),
        (5 + (k % 90) / 10 + (c % 30) / 10).alias("b"),
        (1 + (c % 25) / 10).alias("g"),
        (6 + k % 9).cast("double").alias("m"),
        (k % 7 == 0).alias("wild"),
        (k % 5 == 0).alias("unnamed"),
        (c % 40 + 1).alias("fee"),
        *more,
    )


def _n(x: Column) -> Column:
    return F.format_string("%.1f", x)


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


OPINION = "Opinion of the Financial Advisor"


def _sectioned(docs: DataFrame, text: Column, *more: Column, heading: Column | str = OPINION) -> DataFrame:
    """Documents of a heading and a text below it, with the heading as a line."""
    h = F.lit(heading) if isinstance(heading, str) else heading
    line = F.struct(F.lit(0).alias("start"), F.length(h).alias("end"), F.lit(0.0).alias("bold"), F.lit(0.0).alias("linked"))
    return docs.select("o_orderkey", F.concat(h, F.lit("\n"), text).alias("text"), F.array(line).alias("lines"), *more)


def _facts(docs: DataFrame, text: Column, heading: Column | str = OPINION) -> DataFrame:
    return X.extract(_sectioned(docs, text, heading=heading), "o_orderkey", lines="lines")


R = lambda c: F.round(c, 4)


def _out(found: DataFrame, *more: str) -> DataFrame:
    return found.select("o_orderkey", "field", R("low").alias("low"), R("high").alias("high"), *more)


FORWARD = ("SELECT o_orderkey, 'discount_rate' AS field, round(a, 4) AS low, round(b, 4) AS high, house AS advisor, 'dcf' AS analysis FROM d UNION ALL SELECT o_orderkey, 'terminal_growth', round(g, 4), round(g, 4), house, 'dcf' FROM d"
           " UNION ALL SELECT o_orderkey, 'exit_multiple', m::DOUBLE, m + 2.5::DOUBLE, house, 'dcf' FROM d")  # fmt: skip


@add("grammar_forward", f"WITH {NUMBERS} {FORWARD}")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join(c("house"), " performed a discounted cash flow analysis. It applied discount rates ranging from ", _n(c("a")), "% to ", _n(c("b")), "% and a perpetuity growth rate of ", _n(c("g")), "%, and exit multiples of ", _n(c("m")), "x to ", _n(c("m") + 2.5), "x.")
    return _out(_facts(d, text), "advisor", "analysis")


@add("grammar_reversed", f"WITH {NUMBERS} SELECT o_orderkey, 'discount_rate' AS field, round(a, 4) AS low, round(a, 4) AS high FROM d UNION ALL SELECT o_orderkey, 'terminal_growth', round(-g, 4), round(g, 4) FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    return _out(_facts(d, _join("Using a ", _n(c("a")), "% discount rate and (", _n(c("g")), ")% to ", _n(c("g")), "% perpetuity growth.")))


@add("grammar_list", f"WITH {NUMBERS} SELECT o_orderkey, 'discount_rate' AS field, round(unnest([a, a + 1, a + 2]), 4) AS low, round(unnest([a, a + 1, a + 2]), 4) AS high FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    return _out(_facts(d, _join("It used discount rates of ", _n(c("a")), "%, ", _n(c("a") + 1), "% and ", _n(c("a") + 2), "% for the three plans; growth was ", _n(c("g")), "% a year.")))


@add("grammar_implied", f"WITH {NUMBERS} SELECT o_orderkey, 'implied_growth' AS field, round(g, 4) AS low, round(g + 1, 4) AS high FROM d UNION ALL SELECT o_orderkey, 'exit_multiple', m::DOUBLE, m::DOUBLE FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    return _out(_facts(d, _join("An exit multiple of ", _n(c("m")), "x was applied. This resulted in implied perpetuity growth rates of ", _n(c("g")), "% to ", _n(c("g") + 1), "%.")))


@add("grammar_none", "SELECT count(*) AS documents, 0 AS values FROM documents")
def _(spark, sf_dir):
    """Texts without valuations: all are read, and none states a value."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lex = lexemes(docs, "text", "doc_id", prefilter=False, outer=True)
    found = X.candidates(lex, "doc_id").agg(F.count("*").cast("int").alias("values"))
    return lex.agg(F.count_distinct("doc_id").alias("documents")).select("documents", found.scalar().alias("values"))


@add("rejections_by_reason", f"""WITH {NUMBERS}, r AS (SELECT CASE WHEN wild THEN 'outside_hard_bounds' WHEN unnamed THEN 'no_analysis_marker' END AS reason FROM d) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    analysis = F.when(c("unnamed"), "review").otherwise("discounted cash flow analysis")
    rate = F.when(c("wild"), _n(c("a") + 80)).otherwise(_n(c("a")))
    return _facts(d, _join(c("house"), " performed a ", analysis, " with a discount rate of ", rate, "%.")).groupBy("reason").agg(F.count("*").alias("n"))


@add("rejections_by_place", f"""WITH {NUMBERS} SELECT o_orderkey, CASE fee % 3 WHEN 0 THEN 'opinion' WHEN 1 THEN 'context' ELSE 'other' END AS region, CASE fee % 3 WHEN 1 THEN 'no_analysis_marker' WHEN 2 THEN 'outside_analysis_context' END AS reason,
  CASE fee % 3 WHEN 0 THEN house ELSE 'unattributed' END AS advisor, CASE fee % 3 WHEN 0 THEN 'dcf' ELSE 'unspecified' END AS analysis FROM d""")
def _(spark, sf_dir):
    """A value counts in an opinion; outside, a house and an analysis near it make a context that proves nothing."""
    d, c = _documents(spark, sf_dir), F.col
    kind = c("fee") % 3
    heading = F.when(kind == 0, OPINION).otherwise("Stock Purchase Plan")
    text = F.when(kind < 2, _join(c("house"), " performed a discounted cash flow analysis with a discount rate of ", _n(c("a")), "%.")).otherwise(_join("The plan has a discount rate of ", _n(c("a")), "%."))
    return _facts(d, text, heading).select("o_orderkey", "region", "reason", "advisor", "analysis")


@add("rejections_of_values", f"""WITH {NUMBERS} SELECT o_orderkey, CASE fee % 4 WHEN 0 THEN 'not_dcf_analysis' WHEN 1 THEN 'not_dcf_analysis' END AS reason, CASE fee % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'unspecified' WHEN 2 THEN 'pv_future_price' ELSE 'nav' END AS analysis FROM d""")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    what = F.when(c("fee") % 4 == 0, "Selected Companies Analysis").when(c("fee") % 4 == 1, "A Review").when(c("fee") % 4 == 2, "Present Value of Future Share Prices").otherwise("Net Asset Value Analysis")
    text = _join(what, ". This implied a range of values per share of $", F.format_string("%.2f", c("a") * 10), " to $", F.format_string("%.2f", c("b") * 10 + 1), ".")
    return _facts(d, text).where("field = 'value_per_share'").select("o_orderkey", "reason", "analysis")


@add("analysis_classes", f"""WITH {NUMBERS} SELECT o_orderkey, CASE fee % 5 WHEN 0 THEN 'ddm' WHEN 1 THEN 'dcf' WHEN 2 THEN 'other' WHEN 3 THEN 'dcf' ELSE 'ddm' END AS analysis FROM d""")
def _(spark, sf_dir):
    """The last mark of its own line or a line's start decides; without one the last mark in running text that is no comparison."""
    d, c = _documents(spark, sf_dir), F.col
    long = "the board of directors heard at some length that in the view of its advisors and of the management of the business a further look at all of the figures was needed, "
    rate = _join(" a discount rate of ", _n(c("a")), "%.")
    kind = c("fee") % 5
    text = (
        F.when(kind == 0, _join("Dividend Discount Analysis\n", long, "and a discounted cash flow was seen with", rate))
        .when(kind == 1, _join(long, "and a discounted cash flow was seen beside selected companies with", rate))
        .when(kind == 2, _join("Discounted Cash Flow Analysis\nSelected Companies Analysis\n", long, "with", rate))
        .when(kind == 3, _join("Selected companies were seen first in brief.\nDiscounted Cash Flow Analysis\n", long, "with", rate))
        .otherwise(_join(long, "a net asset value and then a dividend discount was seen with", rate))
    )
    return _facts(d, text).select("o_orderkey", "analysis")


@add("section_advisors", f"""WITH {NUMBERS} SELECT o_orderkey, CASE fee % 4 WHEN 0 THEN 'Moelis' WHEN 1 THEN house WHEN 2 THEN 'Jefferies' ELSE 'unattributed' END AS advisor FROM d""")
def _(spark, sf_dir):
    """Without a house that acts, the heading's house, else the house named most in the section."""
    d, c = _documents(spark, sf_dir), F.col
    kind = c("fee") % 4
    heading = F.when(kind == 0, "Opinion of Moelis & Company").otherwise(OPINION)
    named = F.when(kind == 0, "For UBS and UBS.").when(kind == 1, _join("Moelis met UBS. For UBS, ", c("house"), " performed it.")).when(kind == 2, "Met UBS. Met Jefferies. Of UBS. Of Jefferies. In Jefferies.").otherwise("Nobody is named.")
    return _facts(d, _join("Discounted Cash Flow Analysis\n", named, "\nThe discount rate was ", _n(c("a")), "%."), heading).select("o_orderkey", "advisor")


@add("table_rows", f"WITH {NUMBERS} SELECT o_orderkey, round(a, 4) AS low, CASE WHEN fee % 3 < 2 THEN 'table_row' END AS reason FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    end = F.when(c("fee") % 3 == 0, " | 7").when(c("fee") % 3 == 1, " 10.0%").otherwise(" in all.")
    text = _join(c("house"), " performed a discounted cash flow analysis with a discount rate of ", _n(c("a")), "%", end)
    return _facts(d, text).select("o_orderkey", R("low").alias("low"), "reason")


@add("advisor_fees", f"WITH {NUMBERS} SELECT o_orderkey, 'fee_total' AS field, fee + 0.5::DOUBLE AS low, house FROM d UNION ALL SELECT o_orderkey, 'fee_opinion', fee / 4.0::DOUBLE, house FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join("The Company agreed to pay ", c("house"), " a fee of $", _n(c("fee") + 0.5), " million, $", F.format_string("%.2f", c("fee") / 4), " million upon delivery of its opinion.")
    return X.money_terms(lexemes(dealt(d.select("o_orderkey", text.alias("text")), "o_orderkey"), "text", "o_orderkey", by=("o_orderkey",)), "o_orderkey").select("o_orderkey", "field", R("low").alias("low"), "house")


@add("per_share_values", f"WITH {NUMBERS} SELECT o_orderkey, 'value_per_share' AS field, round(a * 10, 4) AS low, round(b * 10 + 1, 4) AS high FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join("This indicated a range of implied values per share of $", F.format_string("%.2f", c("a") * 10), " to $", F.format_string("%.2f", c("b") * 10 + 1), ".")
    return _out(X.money_terms(lexemes(dealt(d.select("o_orderkey", text.alias("text")), "o_orderkey"), "text", "o_orderkey", by=("o_orderkey",)), "o_orderkey"))


@add("offer_price", f"WITH {NUMBERS} SELECT o_orderkey, round(a * 4, 4) AS low, 2 AS votes FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    price = F.format_string("%.2f", c("a") * 4)
    text = _join("Holders will receive $", price, " in cash. An earlier merger consideration of $3.00 in cash was refused. Each share has the right to receive $", price, " in cash.")
    return X.offer_price(lexemes(dealt(d.select("o_orderkey", text.alias("text")), "o_orderkey"), "text", "o_orderkey", by=("o_orderkey",)), "o_orderkey").select("o_orderkey", R("low").alias("low"), F.col("votes").cast("int").alias("votes"))


@add("fee_cases", f"""WITH {NUMBERS} SELECT o_orderkey, unnest(CASE fee % 6 WHEN 0 THEN ['fee_total', 'fee_opinion', 'fee_contingent'] WHEN 1 THEN ['fee_total', 'fee_opinion'] WHEN 2 THEN ['fee_opinion'] WHEN 3 THEN ['fee_total'] ELSE [] END) AS field,
  unnest(CASE fee % 6 WHEN 0 THEN [fee + 2.5::DOUBLE, 1.5, fee + 1.0] WHEN 1 THEN [fee + 0.5::DOUBLE, fee + 0.5] WHEN 2 THEN [fee + 0.5::DOUBLE] WHEN 3 THEN [fee + 0.5::DOUBLE] ELSE [] END) AS low, house FROM d""")
def _(spark, sf_dir):
    """A total of which parts are paid; one amount as both; an opinion's fee that is credited; a plain total; and payments that are no advisor's fee."""
    d, c = _documents(spark, sf_dir), F.col
    money = lambda x: F.concat(F.lit("$"), F.format_string("%.1f", x), F.lit(" million"))
    whole, kind = money(c("fee") + 0.5), c("fee") % 6
    text = (
        F.when(kind == 0, _join(c("house"), " will receive an aggregate fee of approximately ", money(c("fee") + 2.5), ", of which $1.5 million became payable upon delivery of its opinion and ", money(c("fee") + 1.0), " is contingent upon the closing of the merger."))
        .when(kind == 1, _join("The Company will pay ", c("house"), " a fee of ", whole, " upon the rendering of its opinion."))
        .when(kind == 2, _join("The Company will pay ", c("house"), " a fee of ", whole, " upon the rendering of its opinion, which is creditable."))
        .when(kind == 3, _join("For its services ", c("house"), " will be paid a fee of ", whole, "."))
        .when(kind == 4, _join(c("house"), " advised. The Company must pay a termination fee of ", whole, "."))
        .otherwise(_join("In the past two years ", c("house"), " had a fee of ", whole, " for other work."))
    )
    return X.money_terms(lexemes(dealt(d.select("o_orderkey", text.alias("text")), "o_orderkey"), "text", "o_orderkey", by=("o_orderkey",)), "o_orderkey").select("o_orderkey", "field", R("low").alias("low"), "house")


@add("per_share_cases", f"WITH {NUMBERS} SELECT o_orderkey, round(a * 10, 4) AS low FROM d WHERE fee % 5 < 2")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    values, kind = _join("$", F.format_string("%.2f", c("a") * 10), " to $", F.format_string("%.2f", c("b") * 10 + 1)), c("fee") % 5
    text = (
        F.when(kind == 0, _join("This implied a range of values per share of ", values, " for common stock."))
        .when(kind == 1, _join("It resulted in illustrative present values of ", values, " per share."))
        .when(kind == 2, _join("The stock traded between ", values, " per share during the period."))
        .when(kind == 3, _join("The implied values per share beside the 52-week closing price were ", values, "."))
        .otherwise(_join("Implied values per share: | ", values, " | 7"))
    )
    return X.money_terms(lexemes(dealt(d.select("o_orderkey", text.alias("text")), "o_orderkey"), "text", "o_orderkey", by=("o_orderkey",)), "o_orderkey").select("o_orderkey", R("low").alias("low"))


@add("offer_cases", f"WITH {NUMBERS} SELECT o_orderkey, round(a * 4, 4) AS low, 2 AS votes FROM d WHERE fee % 5 = 0")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    price, kind = F.format_string("%.2f", c("a") * 4), c("fee") % 5
    once = (
        F.when(kind == 0, _join("Each share has the right to receive $", price, " in cash, without interest. "))
        .when(kind == 1, _join("Each share has the right to receive $", price, " in cash and 0.776 of a share of Parent common stock. "))
        .when(kind == 2, _join("A holder of an option will receive $", price, " in cash. "))
        .when(kind == 3, _join("Each share has the right to receive $", price, " of notes. "))
        .otherwise(_join("The initial proposal was a price of $", price, " in cash. "))
    )
    return X.offer_price(lexemes(dealt(d.select("o_orderkey", F.concat(once, once).alias("text")), "o_orderkey"), "text", "o_orderkey", by=("o_orderkey",)), "o_orderkey").select("o_orderkey", R("low").alias("low"), F.col("votes").cast("int").alias("votes"))


@add("valuation_dates", f"""WITH {NUMBERS} SELECT o_orderkey, CASE fee % 5 WHEN 0 THEN '2022-09-30' WHEN 1 THEN '2022-09-30' WHEN 2 THEN '2021-12-31' ELSE '' END AS valuation_date FROM d""")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    kind = c("fee") % 5
    said = (
        F.when(kind == 0, "discounted to present value as of September 30, 2022 at")
        .when(kind == 1, "discounted to present value as of 30 September 2022 at")
        .when(kind == 2, "discounted as of March 31, 2020 for all of the many earlier years, and then valued to December 31, 2021 at")
        .when(kind == 3, "discounted at the meeting held on May 3, 2021 at")
        .otherwise("discounted as of February 30, 2021 at")
    )
    return _facts(d, _join(c("house"), " performed a discounted cash flow analysis in which flows were ", said, " discount rates of ", _n(c("a")), "% to ", _n(c("b") + 1), "%.")).select("o_orderkey", "valuation_date")


@add("snippets", f"""WITH {NUMBERS}, t AS (SELECT o_orderkey, house || ' performed a discounted cash flow analysis with a discount rate of ' || printf('%.1f', a) || '% in all.' AS s FROM d)
  SELECT o_orderkey, s AS snippet, 33 + strpos(s, 'discount rate') - 1 AS start, 33 + strpos(s, '% in all') AS end_, CAST(33 AS BIGINT) AS snippet_start, 33 + length(s) AS snippet_end FROM t""")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join(c("house"), " performed a discounted cash flow analysis with a discount rate of ", _n(c("a")), "% in all. Behind it all.")
    return _facts(d, text).select("o_orderkey", "snippet", *[F.col(x).cast("long").alias(x) for x in ("start", "snippet_start", "snippet_end")], F.col("end").cast("long").alias("end_"))


@add("provenance_verified", f"WITH {NUMBERS} SELECT count(*) * 3 AS facts, count(*) * 3 AS verified FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join(c("house"), " performed a discounted cash flow analysis. It applied discount rates ranging from ", _n(c("a")), "% to ", _n(c("b")), "% and a perpetuity growth rate of ", _n(c("g")), "%, and exit multiples of ", _n(c("m")), "x to ", _n(c("m") + 2.5), "x.")
    return _facts(d, text).agg(F.count("*").alias("facts"), F.sum((F.size("problems") == 0).cast("long")).alias("verified"))


@add("provenance_problems", f"""WITH {NUMBERS} SELECT o_orderkey, CASE fee % 5 WHEN 0 THEN 'span_out_of_range' WHEN 1 THEN 'value_text_not_in_span' WHEN 2 THEN 'value_not_reproduced_from_span' WHEN 3 THEN 'snippet_does_not_contain_span' ELSE '' END AS problems FROM d""")
def _(spark, sf_dir):
    """Facts whose span, value or snippet was changed fail the check that guards it."""
    d, c = _documents(spark, sf_dir), F.col
    kind, raw = c("fee") % 5, _join(_n(c("a")), "%")
    rows = d.select(
        "o_orderkey", F.when(kind == 0, 9).otherwise(3).alias("start"), F.lit(9).alias("end"), F.when(kind == 2, c("a") + 1).otherwise(c("a")).alias("low"), c("a").alias("high"), F.lit("pct").alias("unit"), F.when(kind == 1, "7.77%").otherwise(raw).alias("raw_low"), raw.alias("raw_high"),
        _join("a discount rate of ", raw).alias("span"), F.when(kind == 3, "something else").otherwise(_join("with a discount rate of ", raw, ".")).alias("snippet"),
    )
    checked = X.verify(rows, F.col("span"), F.col("snippet"))
    return checked.select("o_orderkey", F.coalesce(F.get("problems", F.lit(0)), F.lit("")).alias("problems"))


@add("html_round_trip", "SELECT p_partkey, p_name || ' & ' || p_brand || chr(10) || p_type || ' | ' || p_size || chr(10) AS text FROM part")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    html = _join("<html><head><title>no</title></head><body><p>", F.col("p_name"), "&nbsp;&amp; <b>", F.col("p_brand"), "</b></p><script>x='<p>'</script><table><tr><td>", F.col("p_type"), "</td><td>", F.col("p_size").cast("string"), "</td></tr></table></body></html>")
    return html_to_document(p.select("p_partkey", html.alias("html")), "html", "p_partkey").select("p_partkey", "text")


@add("html_documents")
def _(spark, sf_dir):
    docs = html_to_document(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "page_id")
    return docs.select("page_id", F.sha2("text", 256).alias("doc_sha256"), F.length("text").cast("long").alias("n_chars"), F.size("lines").cast("long").alias("n_lines"), html_offset(F.col("runs"), F.lit(0)).cast("long").alias("first_offset"))


@add("segments", f"""WITH {NUMBERS}, t AS (SELECT *, 'Background of the Merger' AS h1, 'Opinion of the Financial Advisor' AS h2, house || ' made an analysis.' AS l2, 'Risk Factors' AS h3 FROM d),
  s AS (SELECT o_orderkey, house, length('Preamble') + 1 AS a, length('Preamble') + 1 + length(h1) + 1 + length('Talks.') + 1 AS b, length('Preamble') + 1 + length(h1) + 1 + length('Talks.') + 1 + length(h2) + 1 + length(l2) + 1 AS c, length(h3) AS e FROM t)
  SELECT o_orderkey, 'other' AS kind, 0 AS start, a AS end_, 'unattributed' AS advisor FROM s UNION ALL SELECT o_orderkey, 'background', a, b, 'unattributed' FROM s UNION ALL SELECT o_orderkey, 'opinion', b, c, house FROM s UNION ALL SELECT o_orderkey, 'other', c, c + e + 1, 'unattributed' FROM s""")
def _(spark, sf_dir):
    d = _documents(spark, sf_dir)
    html = _join("<p>Preamble</p><h2>Background of the Merger</h2><p>Talks.</p><h2>Opinion of the Financial Advisor</h2><p>", F.col("house"), " made an analysis.</p><h2>Risk Factors</h2>")
    docs = html_to_document(d.select("o_orderkey", html.alias("html")), "html", "o_orderkey")
    return S.segments(docs, "o_orderkey").select("o_orderkey", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "advisor")


@add("released_facts", f"""WITH {NUMBERS} SELECT 'D' || (o_orderkey // 2) AS deal_id, 'discount_rate' AS field, round(a, 4) AS low, round(b, 4) AS high, 'core' AS tier, a = b AS is_point, '2020-03-31' AS valuation_date, '' AS metric, '' AS flags FROM d WHERE a <= 25
  UNION ALL SELECT 'D' || (o_orderkey // 2), 'exit_multiple', m::DOUBLE, m + 2.5::DOUBLE, 'core', false, '', 'EBITDA', '' FROM d""")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join(c("house"), " performed a discounted cash flow analysis of order ", c("o_orderkey").cast("string"), " and discounted values to March 31, 2020 using discount rates ranging from ", _n(c("a")), "% to ", _n(c("b")), "%, and EBITDA exit multiples of ", _n(c("m")), "x to ", _n(c("m") + 2.5), "x.")
    docs = _sectioned(d, text).withColumn("accession", c("o_orderkey").cast("string"))
    deal = _join("D", F.floor(c("o_orderkey") / 2).cast("string"))
    filings = d.select(c("o_orderkey").cast("string").alias("accession"), deal.alias("deal_id"), F.lit("1").alias("cik"), c("o_orderkey").cast("string").alias("company"), F.lit("1000").alias("sic"), F.lit("2020-06-01").alias("file_date"))
    # every order speaks for itself here, so that no two filings of a deal state one value
    out = Z.finalize(X.accepted(X.extract(docs, "accession", lines="lines")).withColumn("subject", c("accession")), filings)
    return out.select("deal_id", "field", R("low").alias("low"), R("high").alias("high"), "tier", "is_point", "valuation_date", "metric", "flags")


@add("subjects", f"WITH {NUMBERS} SELECT o_orderkey, round(a, 4) AS low, CASE fee % 4 WHEN 0 THEN 'target' WHEN 1 THEN 'acquirer' WHEN 2 THEN 'pro_forma' ELSE 'unspecified' END AS subject FROM d UNION ALL SELECT o_orderkey, round(a + 1, 4), CASE fee % 4 WHEN 3 THEN 'unspecified' WHEN 1 THEN 'acquirer' WHEN 2 THEN 'pro_forma' ELSE 'target' END FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    who = F.when(c("fee") % 4 == 0, "the Company, not of Buyer that was named before,").when(c("fee") % 4 == 1, "Parent").when(c("fee") % 4 == 2, "the pro forma Company").otherwise("a firm")
    text = _join("For ", who, " discount rates were ", _n(c("a")), "%. In the next year a discount rate of ", _n(c("a") + 1), "% was used.")
    text = F.when(c("fee") % 4 == 0, F.regexp_replace(text, "For the Company, not of Buyer that was named before,", "Unlike Buyer, for the Company")).otherwise(text)
    return _facts(d, text).select("o_orderkey", R("low").alias("low"), "subject")


@add("named_subjects", f"""WITH {NUMBERS} SELECT o_orderkey, CASE WHEN fee % 5 = 4 THEN 'unspecified' WHEN (fee % 5 IN (0, 2)) = (fee % 2 = 0) THEN 'target' ELSE 'acquirer' END AS subject FROM d""")
def _(spark, sf_dir):
    """The filer by its aliases, the other company by its shares; which is the target follows from whose shares are issued."""
    d, c = _documents(spark, sf_dir), F.col
    kind = c("fee") % 5
    who = F.when(kind == 0, "Evoqua Water").when(kind == 1, "Xylem").when(kind == 2, "EVOQUA WATER").when(kind == 3, "Evoqua aside and for Xylem").otherwise("a firm")
    who = F.when(kind == 2, "evoqua water").otherwise(who)
    role = F.when(c("fee") % 2 == 0, "Each share of Evoqua common stock is converted into cash. ").otherwise("A vote on the issuance of shares of Evoqua common stock. ")
    others = F.repeat(F.lit("Holders of Xylem common stock agree. "), 7)
    filler = F.repeat(F.lit("Nothing of note was said by anyone at all about it. "), 60)
    text = _join(role, others, filler, "\nDiscounted Cash Flow Analysis\nFor ", who, " the discount rate was ", _n(c("a")), "%.")
    docs = _sectioned(d, text, F.lit("Evoqua Water Technologies, Inc.").alias("company"))
    return X.extract(docs, "o_orderkey", lines="lines", company="company").where("field = 'discount_rate'").select("o_orderkey", "subject")


@add("company_aliases", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Evo' || c_custkey || ' Water Technologies; Evo' || c_custkey || ' Water; Evo' || c_custkey WHEN 1 THEN 'First Bank' WHEN 2 THEN 'ABN' ELSE 'Anixter Group; Anixter' END AS names FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    company = F.when(k % 4 == 0, _join("Evo", k.cast("string"), " Water Technologies, Inc.")).when(k % 4 == 1, "First Bank Corp.").when(k % 4 == 2, "ABN CO").otherwise("Anixter Group Company, Ltd")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(P.aliases(company), "; ").alias("names"))


@add("filer_roles", f"WITH {NUMBERS} SELECT o_orderkey, CASE WHEN fee % 3 = 1 THEN 'acquirer' ELSE 'target' END AS role FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    issued, converted = "A vote on the issuance of up to 1,500,000 shares of Evoqua common stock. ", "At closing each share of Evoqua common stock becomes the right to receive cash. "
    text = F.when(c("fee") % 3 == 0, converted).when(c("fee") % 3 == 1, issued + issued + converted).otherwise(issued + converted)
    return d.select("o_orderkey", P.filer_role(text, F.array(F.lit("Evoqua Water"), F.lit("Evoqua"))).alias("role"))


@add("other_companies", f"WITH {NUMBERS} SELECT o_orderkey, 'Xylem Water' AS name, fee % 11 AS mentions FROM d WHERE fee % 11 >= 6 UNION ALL SELECT o_orderkey, 'Badger', 7 FROM d")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    text = _join(F.repeat(F.lit("Holders of Xylem Water common stock agree. "), (c("fee") % 11).cast("int")), F.repeat(F.lit("Each of The Badger shares and of Evoqua common stock counts. "), F.lit(7)), F.repeat(F.lit("It owns Rare ordinary shares. "), F.lit(5)))
    docs = d.select("o_orderkey", text.alias("text"), F.array(F.lit("Evoqua")).alias("names"))
    return P.other_companies(docs, "text", "names", "o_orderkey")


GOLD = """
g AS (SELECT o_orderkey AS gold_id, 'A' || (o_orderkey // 100) AS accession, o_orderkey // 100 AS f, CASE o_orderkey % 7 WHEN 0 THEN 'discount_rate' WHEN 1 THEN 'exit_multiple' WHEN 2 THEN 'implied_growth' ELSE 'terminal_growth' END AS field, (o_orderkey % 50) / 2.0::DOUBLE AS low,
  o_orderkey % 10 = 0 AS gone, o_orderkey % 8 = 0 AS twice, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Lazard' ELSE 'Evercore' END AS advisor, CASE WHEN o_orderkey % 6 = 0 THEN 'UBS' WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN 'Lazard' ELSE 'Evercore' END AS said FROM orders)
"""


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels, and predictions that miss every tenth and repeat every eighth; spans do not overlap across labels."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    house = F.when(c == 0, "").when(c == 1, "Lazard").otherwise("Evercore")
    g = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("gold_id"), F.concat(F.lit("A"), F.floor(k / 100).cast("string")).alias("accession"),
        F.when(k % 7 == 0, "discount_rate").when(k % 7 == 1, "exit_multiple").when(k % 7 == 2, "implied_growth").otherwise("terminal_growth").alias("field"),
        ((k % 50) / 2).alias("low"), ((k % 50) / 2).alias("high"), (k * 10).alias("span_start"), (k * 10 + 5).alias("span_end"), house.alias("advisor"),
    )
    said = g.withColumn("advisor", F.when(F.col("gold_id") % 6 == 0, "UBS").otherwise(F.col("advisor")))
    once = said.where("gold_id % 10 <> 0").withColumn("predicted_id", F.col("gold_id") * 2).withColumn("span_start", F.col("span_start") + 2)
    twice = said.where("gold_id % 8 = 0").withColumn("predicted_id", F.col("gold_id") * 2 + 1)
    return g, once.unionByName(twice).drop("gold_id")


@add("match_greedy", f"""WITH {GOLD} SELECT accession, field, gold_id, CASE WHEN NOT gone THEN gold_id * 2 WHEN twice THEN gold_id * 2 + 1 END AS predicted_id FROM g UNION ALL SELECT accession, field, NULL, gold_id * 2 + 1 FROM g WHERE twice AND NOT gone""")
def _(spark, sf_dir):
    return E.match(*_gold(spark, sf_dir))


@add("evaluate_by_field", f"""WITH {GOLD}, c AS (SELECT field, count(*) FILTER (WHERE NOT gone OR twice) AS tp, count(*) FILTER (WHERE twice AND NOT gone) AS fp, count(*) FILTER (WHERE gone AND NOT twice) AS fn FROM g GROUP BY 1)
  SELECT field, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""")
def _(spark, sf_dir):
    out = E.evaluate(E.match(*_gold(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@add("evaluate_by_group", f"""WITH {GOLD}, s AS (SELECT *, 'era' AS stratum, CASE f % 3 WHEN 0 THEN 'early' ELSE 'late' END AS label FROM g UNION ALL SELECT *, 'advisor', CASE f % 2 WHEN 0 THEN 'Lazard' ELSE 'UBS' END FROM g),
  c AS (SELECT stratum, label, count(*) FILTER (WHERE NOT gone OR twice) AS tp, count(*) FILTER (WHERE twice AND NOT gone) AS fp, count(*) FILTER (WHERE gone AND NOT twice) AS fn FROM s WHERE field <> 'implied_growth' GROUP BY 1, 2)
  SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""")
def _(spark, sf_dir):
    gold, predicted = _gold(spark, sf_dir)
    own = gold.select("accession", F.substring("accession", 2, 20).cast("long").alias("f")).distinct()
    era = own.select("accession", F.lit("era").alias("stratum"), F.when(F.col("f") % 3 == 0, "early").otherwise("late").alias("label"))
    advisor = own.select("accession", F.lit("advisor").alias("stratum"), F.when(F.col("f") % 2 == 0, "Lazard").otherwise("UBS").alias("label"))
    out = E.evaluate_groups(E.match(gold, predicted), era.unionByName(advisor))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@add("confusion", f"WITH {GOLD} SELECT accession, advisor AS want, said AS got, count(*) AS n FROM g WHERE (NOT gone OR twice) AND advisor <> '' GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    gold, predicted = _gold(spark, sf_dir)
    return E.confusion(E.match(gold, predicted), gold, predicted, "advisor")


@add("bootstrap_precision")
def _(spark, sf_dir):
    gold, predicted = _gold(spark, sf_dir)
    return E.bootstrap_precision(E.match(gold, predicted), gold.select("accession").distinct())


__all__ = ["QUERIES"]

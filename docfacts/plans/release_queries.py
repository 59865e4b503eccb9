"""Queries of verification, release, exact statistics, matching and quotes, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import evaluation as E
from ..operators import exhibits as X
from ..operators import finalize as Z
from ..operators import results as T
from ..operators import sections as S
from ..operators.durable import shared_dir, written
from ..operators import verification as V
from ..sources import release as L
from ..sources import tables as W
from ..sources.html import html_offsets, html_to_document
from .fact_view import SQL as VIEW
from .fact_view import facts as fact_rows
from .fact_view import yields
from .queries import CENTRE, FLAGS, HALF, PAIRS, RATES, UNITS, _flags, _pairs, _rounded, add
from .text_queries import GOLD, NUMBERS, _documents, _gold, _join, _n

# Stored facts and texts by rule, without any extraction: what is wrong with a fact hangs on its order's customer.
TEXTS = f"""WITH {NUMBERS}, k AS (SELECT d.*, o_custkey % 9 AS k FROM d JOIN orders USING (o_orderkey)),
p AS (SELECT o_orderkey, f.field, CASE WHEN k = 1 OR k = 8 THEN 'document_changed' WHEN k = 2 THEN 'document_missing' WHEN k = 3 AND field = 'discount_rate' THEN 'value_not_reproduced' WHEN k = 4 AND field = 'discount_rate' THEN 'snippet_not_verbatim'
  WHEN k = 5 AND field = 'exit_multiple' THEN 'span_out_of_range' WHEN k = 6 AND field = 'fee_total' THEN 'value_text_not_in_span;value_not_reproduced' WHEN k = 7 AND field = 'exit_multiple' THEN 'snippet_does_not_contain_span' ELSE '' END AS problems
  FROM k, (SELECT unnest(['discount_rate', 'exit_multiple', 'fee_total']) AS field) f)"""


def _release(spark, sf_dir):
    """(facts, texts) of orders; by o_custkey % 9 a text is changed or gone, or one fact is."""
    c = F.col
    d = _documents(spark, sf_dir, (c("o_custkey") % 9).alias("k"))
    before = _join(c("house"), " used ")
    rates = _join("discount rates ranging from ", _n(c("a")), "% to ", _n(c("b")), "%")
    middle, exits = F.lit("  in its analysis,\nand "), _join("exit multiples of ", _n(c("m")), "x")
    fee = _join("$", c("fee").cast("string"), " million")
    # columns, so that numbers are written once for all that holds them
    d = d.withColumns({"rates": rates, "exits": exits, "paid": fee})
    rates, exits, fee = c("rates"), c("exits"), c("paid")
    d = d.withColumn("text", F.concat(before, rates, middle, exits, F.lit(". The fee is "), fee, F.lit(".")))
    text = c("text")
    at = {"discount_rate": F.length(before), "exit_multiple": F.length(F.concat(before, rates, middle)), "fee_total": F.length(text) - 1 - F.length(fee)}
    said = {"discount_rate": rates, "exit_multiple": exits, "fee_total": fee}
    values = {"discount_rate": (c("a"), c("b"), _join(_n(c("a")), "%"), _join(_n(c("b")), "%")), "exit_multiple": (c("m"), c("m"), _join(_n(c("m")), "x"), _join(_n(c("m")), "x")), "fee_total": (c("fee").cast("double"), c("fee").cast("double"), fee, fee)}
    make = lambda f: F.struct(
        F.lit(f).alias("field"), F.round(values[f][0], 4).alias("low"), F.round(values[f][1], 4).alias("high"), values[f][2].alias("raw_low"), values[f][3].alias("raw_high"), at[f].alias("span_start"), (at[f] + F.length(said[f])).alias("span_end"),
    )
    rows = d.select("k", c("o_orderkey").cast("string").alias("accession"), F.length(text).alias("n"), F.regexp_replace(text, r"\s+", " ").alias("snippet"), F.sha2(text, 256).alias("doc_sha256"), at["exit_multiple"].alias("x_at"), F.explode(F.array(*map(make, at))).alias("f"))
    is_, k = (lambda f: c("f.field") == f), c("k")
    facts = rows.select(
        F.concat("accession", F.lit(":"), "f.field").alias("fact_id"), "accession", "f.field", F.when((k == 3) & is_("discount_rate"), c("f.low") + 1).otherwise(c("f.low")).alias("low"), "f.high", "f.raw_low", "f.raw_high",
        F.when((k == 6) & is_("fee_total"), c("x_at")).otherwise(c("f.span_start")).alias("span_start"), F.when((k == 5) & is_("exit_multiple"), 1_000_000).when((k == 6) & is_("fee_total"), c("x_at") + 8).otherwise(c("f.span_end")).alias("span_end"),
        F.when((k == 7) & is_("exit_multiple"), c("x_at") + 1).otherwise(F.lit(0)).alias("snippet_start"), F.when((k == 5) & is_("exit_multiple"), 1_000_000).otherwise(c("n")).alias("snippet_end"),
        F.when((k == 4) & is_("discount_rate"), F.concat("snippet", F.lit("!"))).otherwise(c("snippet")).alias("snippet"), F.when((k == 8) & is_("fee_total"), "0").otherwise(c("doc_sha256")).alias("doc_sha256"),
    )
    texts = d.where("k <> 2").select(c("o_orderkey").cast("string").alias("accession"), F.when(c("k") == 1, F.concat(F.lit(" "), text)).otherwise(text).alias("text"))
    return facts, texts


@add("verify_release", f"{TEXTS} SELECT o_orderkey, field, problems FROM p")
def _(spark, sf_dir):
    facts, texts = _release(spark, sf_dir)
    out = V.verify_release(facts, texts)
    return out.select(F.col("accession").cast("long").alias("o_orderkey"), "field", F.array_join("problems", ";").alias("problems"))


@add("verification_report", f"{TEXTS} SELECT count(*) AS checked, count(*) FILTER (WHERE problems = '') AS verified, count(*) FILTER (WHERE problems = 'document_missing') AS missing, count(*) FILTER (WHERE problems = 'document_changed') AS changed, count(*) FILTER (WHERE problems <> '' AND problems NOT LIKE 'document%') AS span_mismatch, false AS ok FROM p")
def _(spark, sf_dir):
    return V.verification_report(V.verify_release(*_release(spark, sf_dir)))


@add("pair_ecdf_steps", f"WITH {PAIRS}, r AS (SELECT round(abs_diff, 6) AS value FROM pairs) SELECT value, round(row_number() OVER (ORDER BY value) / count(*) OVER ()::DOUBLE, 9) AS step FROM r")
def _(spark, sf_dir):
    return _rounded(A.ecdf_steps(_rounded(_pairs(spark, sf_dir), "abs_diff"), "abs_diff"), "step", digits=9)


# Quotes of all documents: 30 characters from the 41st on, their white space written anew; DuckDB's pattern is made of the same words.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
QUOTES = rf"""WITH q AS (SELECT doc_id, text, list_filter(regexp_split_to_array(substr(text, 41, 30), '{SPACE}+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, text, array_to_string(list_transform(w, lambda x: regexp_escape(x)), '{SPACE}+') AS p FROM q WHERE len(w) > 0),
m AS (SELECT doc_id, text, regexp_extract_all(text, p) AS m FROM p)"""


@add("quote_occurrences", f"{QUOTES} SELECT q.doc_id, CAST(coalesce(len(m), 0) AS INTEGER) AS matches, strpos(m.text, m[1]) - 1 AS start, strpos(m.text, m[1]) - 1 + length(m[1]) AS end_ FROM q LEFT JOIN m ON q.doc_id = m.doc_id")
def _(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("accession"), "text")
    quote = F.regexp_replace(F.substring("text", 41, 30), E.SPACE + "+", " \n ")
    found = E.locate_quotes(d.select("accession", quote.alias("quote"), F.lit(1).alias("occurrence")), d)
    return found.select(F.col("accession").alias("doc_id"), "matches", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"))


@add("match_near_values", """WITH g AS (SELECT l_orderkey, l_linenumber, l_orderkey // 50 AS f, l_quantity, row_number() OVER (PARTITION BY l_orderkey // 50, l_quantity ORDER BY l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey // 50, l_quantity) AS n FROM lineitem)
  SELECT 'A' || f AS accession, l_orderkey * 10 + l_linenumber AS gold_id, CASE WHEN k <= n // 2 THEN nth END AS predicted_id FROM (SELECT g.*, p.l_orderkey * 10 + p.l_linenumber AS nth FROM g LEFT JOIN g p ON g.f = p.f AND g.l_quantity = p.l_quantity AND p.k = 2 * g.k)""")
def _(spark, sf_dir):
    """Offer prices of equal values in one document, each second of them predicted with a value a little off: served in order."""
    k, q = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_quantity").cast("double")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("A"), F.floor(F.col("l_orderkey") / 50).cast("string")).alias("accession"), F.lit("offer_price").alias("field"), q.alias("low"), k.alias("id"))
    rows = rows.withColumns({"span_start": F.col("id"), "span_end": F.col("id") + 1})
    second = rows.withColumn("k", F.row_number().over(Window.partitionBy("accession", "low").orderBy("id"))).where("k % 2 = 0").drop("k").withColumn("low", F.col("low") + 5e-10)
    gold, predicted = (x.withColumn("high", F.col("low")).withColumnRenamed("id", i) for x, i in ((rows, "gold_id"), (second, "predicted_id")))
    return E.match(gold, predicted).where("gold_id IS NOT NULL").select("accession", "gold_id", "predicted_id")


# Where values of a converted document stand in its source: by rule, as the source is made of the same parts.
SOURCE = "'<p>' || house || ' &amp; Co&nbsp;paid <b>' || printf('%.1f', a) || '%</b></p><table><tr><td>Fee</td><td>' || fee || ' units</td></tr></table>'"


@add("fact_source_offsets", f"WITH {NUMBERS}, h AS (SELECT o_orderkey, a, fee, {SOURCE} AS html FROM d) SELECT o_orderkey, 'rate' AS what, strpos(html, '<b>') + 2 AS html_pos FROM h UNION ALL SELECT o_orderkey, 'fee', strpos(html, fee || ' units') - 1 FROM h UNION ALL SELECT o_orderkey, 'break', NULL FROM h")
def _(spark, sf_dir):
    d, c = _documents(spark, sf_dir), F.col
    html = _join("<p>", c("house"), " &amp; Co&nbsp;paid <b>", _n(c("a")), "%</b></p><table><tr><td>Fee</td><td>", c("fee").cast("string"), " units</td></tr></table>")
    docs = html_to_document(d.select("o_orderkey", "a", "fee", html.alias("html")), "html", "o_orderkey", "a", "fee")
    places = {"rate": F.instr("text", F.lit("paid ")) + 4, "fee": F.instr("text", F.lit(" units")) - 1 - F.length(c("fee").cast("string")), "break": F.instr("text", F.lit("\n")) - 1}
    at = docs.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("position")) for k, v in places.items()])).alias("p")).select("o_orderkey", "p.*")
    return html_offsets(at, docs, "o_orderkey").select("o_orderkey", "what", c("html_pos").cast("long").alias("html_pos"))


# A release of all facts: what the view lacks of the format's columns is made by rule, with commas, quotes, line feeds and empty text.
FULL = f"""{VIEW}, n AS (SELECT *, accession || ':' || field || ':' || span_start || ':' || low || ':' || advisor || ':' || subject || ':' || analysis || ':' || high AS fact_id FROM facts),
released AS (SELECT DISTINCT fact_id, deal_id, accession, '000' || substr(deal_id, 2) AS cik, company, sic, CAST(filing_date AS VARCHAR) AS filing_date, CAST(year AS INTEGER) AS year, field, low, high, CASE WHEN field = 'exit_multiple' THEN 'x' ELSE 'pct' END AS unit, 'core' AS tier, low = high AS is_point,
  advisor, subject, analysis, 'opinion' AS region, '' AS metric, '' AS valuation_date, '' AS flags, CAST(1 AS BIGINT) AS n_filings, CAST(span_start AS INTEGER) AS span_start, CAST(span_start + 9 AS INTEGER) AS span_end, CAST(0 AS INTEGER) AS snippet_start, CAST(span_start + 20 AS INTEGER) AS snippet_end,
  'a "' || advisor || '", ' || chr(10) || ' said \\ ' || field AS snippet, '' AS raw_low, 'x,' AS raw_high, md5(fact_id) AS doc_sha256 FROM n)"""


def _full(spark, sf_dir) -> DataFrame:
    """Facts of the view with all columns of the format."""
    c, lit = F.col, F.lit
    rows = fact_rows(spark, sf_dir)
    key = F.concat_ws(":", "accession", "field", c("span_start").cast("string"), c("low").cast("string"), "advisor", "subject", "analysis", c("high").cast("string"))
    more = {
        "fact_id": key, "cik": F.concat(lit("000"), F.substring("deal_id", 2, 30)), "filing_date": c("filing_date").cast("string"), "unit": F.when(c("field") == "exit_multiple", "x").otherwise("pct"), "tier": lit("core"), "is_point": c("low") == c("high"), "region": lit("opinion"), "metric": lit(""),
        "valuation_date": lit(""), "flags": lit(""), "n_filings": lit(1), "span_end": c("span_start") + 9, "snippet_start": lit(0), "snippet_end": c("span_start") + 20, "snippet": F.concat(lit('a "'), "advisor", lit('", \n said \\ '), "field"), "raw_low": lit(""), "raw_high": lit("x,"), "doc_sha256": F.md5(key), "not_released": lit(1),
    }
    # all other columns follow from those of the view, so rows are made distinct before they grow
    return rows.distinct().withColumns(more)


@add("release_round_trip", f"WITH {FULL} SELECT * EXCLUDE (fact_id, doc_sha256), 'both' AS found_in FROM released")
def _(spark, sf_dir):
    """All facts published and loaded again, as Parquet and as CSV: rows of both, or of one only."""
    path = f"{shared_dir(spark)}/release-{uuid.uuid4().hex}"
    name = L.publish(spark, path, _full(spark, sf_dir))
    parquet, text = L.load(spark, path), L.load(spark, f"{path}/{L.RELEASES}/{name}/facts.csv")
    return L.compared(parquet, text, "parquet", "csv").drop("fact_id", "doc_sha256")


TREE = {
    "$.analyses.bank_disagreement.discount_rate.": (PAIRS, "pairs", {"n_pairs": "count(*)", "n_deals": "count(DISTINCT deal_id)", "median_pp": "median(abs_diff)", "p25_pp": "quantile_cont(abs_diff, 0.25)", "p75_pp": "quantile_cont(abs_diff, 0.75)", "mean_pp": "avg(abs_diff)", "share_ge_1pp": "avg(CASE WHEN abs_diff >= 1 THEN 1.0::DOUBLE ELSE 0 END)", "share_ge_2pp": "avg(CASE WHEN abs_diff >= 2 THEN 1.0::DOUBLE ELSE 0 END)", "max_pp": "max(abs_diff)"}),
    "$.analyses.implied_growth.": (UNITS, "units", {"n_units": "count(*)", "n_covered": "count(*) FILTER (WHERE covered)", "bounds[1].bound": "max(4)", "bounds[1].high_above": "count(*) FILTER (WHERE covered AND implied_high > 4)"}),
    "$.analyses.market_practice.": (RATES, "rates WHERE NOT financial", {"discount.n": "count(*)", "growth.n": "count(growth)", "growth.pooled_slope": "regr_slope(growth, y10) * 1e6", "discount.pooled_slope": "regr_slope(discount, y10) * 1e6"}),
    "$.analyses.market_practice_by_year": (RATES, "rates WHERE NOT financial AND year = 1996", {"[1].year": "max(1996)", "[1].n": "count(*)", "[1].discount_median": "median(discount)"}),
    "$.corpus.": (VIEW, "facts", {"n_facts": "count(*)", "n_filings": "count(DISTINCT accession)", "n_deals": "count(DISTINCT deal_id)", "filing_years[0]": "min(year)", "facts_by_field.exit_multiple": "count(*) FILTER (WHERE field = 'exit_multiple')", "facts_by_year.1997": "count(*) FILTER (WHERE year = 1997)", "unattributed_share_of_core": "avg(CASE WHEN advisor = 'unattributed' THEN 1.0::DOUBLE ELSE 0 END)"}),
    "$.corpus.soft_flag_counts.": (FLAGS, "(SELECT unnest(string_split(flags, ';')) AS flag FROM flagged)", {"rate_atypical": "count(*) FILTER (WHERE flag = 'rate_atypical')", "growth_ge_discount": "count(*) FILTER (WHERE flag = 'growth_ge_discount')"}),
}
SLOPES = ("$.analyses.market_practice.growth.pooled_slope", "$.analyses.market_practice.discount.pooled_slope")


@add("result_tree", " UNION ALL ".join(f"SELECT '{at}{k}' AS path, round(CAST({v} AS DOUBLE), 6) AS value FROM (WITH {view} SELECT * FROM {source}) x" for at, (view, source, stats) in TREE.items() for k, v in stats.items()))
def _(spark, sf_dir):
    """Statistics of the tree of results, each read from its JSON."""
    f = written(_flags(spark, sf_dir), "flagged")
    filings = f.select("accession", "deal_id", F.col("filing_date").alias("file_date")).distinct()
    tree = T.as_json(T.result_tree(f, filings, yields(spark, sf_dir), draws=200, stored=True))
    paths = [at + k for at, (_, _, stats) in TREE.items() for k in stats]
    each = tree.select(F.explode(F.create_map(*[x for p in paths for x in (F.lit(p), F.get_json_object("json", p).cast("double"))])).alias("path", "value"))
    return each.withColumn("value", F.round(F.when(F.col("path").isin(*SLOPES), F.col("value") * 1e6).otherwise(F.col("value")), 6))


@add("attribute_accuracy", f"WITH {GOLD} SELECT 'advisor' AS attribute, count(*) AS n, round(avg(CASE WHEN advisor = said THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM g WHERE (NOT gone OR twice) AND advisor <> ''")
def _(spark, sf_dir):
    gold, predicted = _gold(spark, sf_dir)
    return _rounded(E.attribute_accuracy(E.match(gold, predicted), gold, predicted, ["advisor"]), "accuracy")


@add("dominant_advisors", f"WITH {NUMBERS} SELECT o_orderkey, CASE fee % 4 WHEN 0 THEN house WHEN 1 THEN 'UBS' WHEN 2 THEN house ELSE 'unattributed' END AS advisor, CASE fee % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS mentions FROM d")
def _(spark, sf_dir):
    """The first of two named once, one named twice, and none."""
    d, c = _documents(spark, sf_dir), F.col
    kind = c("fee") % 4
    text = F.when(kind == 0, _join(c("house"), " met UBS.")).when(kind == 1, _join(c("house"), " met UBS. UBS left.")).when(kind == 2, _join(c("house"), " came, and ", c("house"), " left.")).otherwise("Nobody came.")
    return S.dominant_advisor(d.select("o_orderkey", text.alias("text")), "o_orderkey").select("o_orderkey", "advisor", c("mentions").cast("int").alias("mentions"))


@add("deal_blocks", f"""WITH {VIEW}, v AS (SELECT * REPLACE (round(low, 4) AS low, round(high, 4) AS high, CASE WHEN analysis = 'ddm' AND span_start % 2 = 0 THEN 'other' ELSE analysis END AS analysis) FROM facts),
  c AS (SELECT deal_id, subject, analysis, field, advisor, count(*) AS n, arg_min(CAST(low AS VARCHAR) || '-' || CAST(high AS VARCHAR), (span_start, low, high)) AS cell FROM v GROUP BY ALL),
  a AS (SELECT DISTINCT deal_id, subject, analysis, advisor FROM c), f AS (SELECT DISTINCT deal_id, subject, analysis, field FROM c),
  rated AS (SELECT deal_id, subject, analysis FROM f WHERE field = 'discount_rate')
  SELECT f.deal_id, f.subject, f.analysis, f.field, string_agg(a.advisor || '=' || coalesce(c.cell || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END, ''), ';' ORDER BY a.advisor = 'unattributed', a.advisor) AS cells
  FROM f JOIN a USING (deal_id, subject, analysis) LEFT JOIN c ON c.deal_id = f.deal_id AND c.subject = f.subject AND c.analysis = f.analysis AND c.field = f.field AND c.advisor = a.advisor
  LEFT JOIN rated r ON r.deal_id = f.deal_id AND r.subject = f.subject AND r.analysis = f.analysis WHERE f.analysis <> 'other' OR r.deal_id IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(spark, sf_dir):
    f = _rounded(fact_rows(spark, sf_dir), "low", "high", digits=4).withColumn("analysis", F.when((F.col("analysis") == "ddm") & (F.col("span_start") % 2 == 0), "other").otherwise(F.col("analysis")))
    cells = F.array_join(F.transform("cells", lambda x: F.concat(x["advisor"], F.lit("="), F.coalesce(x["cell"], F.lit("")))), ";")
    return Z.deal_blocks(f).select("deal_id", "subject", "analysis", "field", cells.alias("cells"))


@add("catalog_from_hits", """SELECT 'a' || o_orderkey AS accession, 'f.htm' AS filename, CAST(o_orderdate AS DATE)::VARCHAR AS file_date, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN c_nationkey < 20 THEN c_name ELSE '' END ELSE 'Old Co ' || o_custkey END AS company,
  CASE WHEN c_nationkey < 20 AND c_nationkey % 2 = 0 THEN '10' || c_nationkey ELSE '9999' END AS sic, CASE WHEN c_nationkey < 20 THEN c_mktsegment ELSE '' END AS sic_description, CASE WHEN c_nationkey < 20 THEN 'T' || o_custkey ELSE '' END AS tickers FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf_dir):
    """Search results with repeated hits, of which the last one counts, and a company dimension that lacks some companies."""
    c, lit = F.col, F.lit
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = F.when(c("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(lit("Old Co "), c("o_custkey").cast("string"), lit("  (TICK) (CIK 0000000001)"))))
    hit = lambda day: F.struct(F.concat(lit("a"), c("o_orderkey").cast("string"), lit(":f.htm")).alias("_id"), F.struct(lit("X").alias("form"), lit("X").alias("file_type"), day.alias("file_date"), F.array(F.lpad(c("o_custkey").cast("string"), 10, "0")).alias("ciks"), names.alias("display_names"), F.array(lit("9999")).alias("sics")).alias("_source"))
    pages = o.select(F.to_json(F.struct(F.struct(F.array(hit(lit("9999-01-01")), hit(c("o_orderdate").cast("date").cast("string"))).alias("hits")).alias("hits"))).alias("value"), lit(1).alias("page"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 20")
    sic = F.when(c("c_nationkey") % 2 == 0, F.concat(lit("10"), c("c_nationkey").cast("string"))).otherwise("")
    records = customers.select(F.to_json(F.struct(c("c_custkey").alias("cik"), c("c_name").alias("name"), sic.alias("sic"), c("c_mktsegment").alias("sicDescription"), F.array(F.concat(lit("T"), c("c_custkey").cast("string"))).alias("tickers"))).alias("value"))
    out = W.filings_from_hits(W.discover(W.hits_from_json(pages, page="page"), "X"), W.companies_from_json(records))
    return out.select("accession", "filename", "file_date", "cik", "company", "sic", "sic_description", F.array_join("tickers", ",").alias("tickers"))


@add("exhibit_rates", f"""WITH {RATES}, y AS (SELECT year, median(discount) AS m, quantile_cont(discount, 0.25) AS a, quantile_cont(discount, 0.75) AS b, median(growth) AS g, count(growth) AS gn, avg(y10) AS y FROM rates WHERE NOT financial GROUP BY 1), t AS (SELECT CAST(floor(greatest(14, max(b) + 1)) AS INTEGER) AS t FROM y)
  SELECT year, round(a, 6) AS discount_q25, round(b, 6) AS discount_q75, round(m, 6) AS discount_median, round(y, 6) AS y10_mean, CASE WHEN gn >= 3 THEN round(g, 6) END AS growth_median, t + t % 2 AS axis_top FROM y, t""")
def _(spark, sf_dir):
    by_year = A.market_by_year(A.deal_rates(fact_rows(spark, sf_dir), yields(spark, sf_dir)))
    return _rounded(X.rates_by_year(by_year), "discount_q25", "discount_q75", "discount_median", "y10_mean", "growth_median")


@add("exhibit_disagreement", f"""WITH {PAIRS}, r AS (SELECT round(abs_diff, 6) AS d FROM pairs), b AS (SELECT unnest(range(0, 10)) AS i), c AS (SELECT CAST(floor(least(d, 5 - 1e-9) / 0.5) AS BIGINT) AS i, count(*) AS n FROM r GROUP BY 1)
  SELECT b.i * 0.5::DOUBLE AS "left", coalesce(n, 0) AS n, b.i >= 2 AS highlighted, round((SELECT avg(CASE WHEN d >= 1 THEN 1.0::DOUBLE ELSE 0 END) FROM r), 6) AS share_highlighted FROM b LEFT JOIN c ON b.i = c.i""")
def _(spark, sf_dir):
    return _rounded(X.disagreement_bars(_rounded(_pairs(spark, sf_dir), "abs_diff")), "share_highlighted")


@add("exhibit_implied_growth", f"""WITH {UNITS}, v AS (SELECT round(implied_high, 6) AS value FROM units WHERE covered)
  SELECT value, round(row_number() OVER (ORDER BY value) / count(*) OVER ()::DOUBLE, 9) AS step, value > 4 AS above, round(avg(CASE WHEN value > 4 THEN 1.0::DOUBLE ELSE 0 END) OVER (), 6) AS share_above, least(-2, floor(min(value) OVER ())) AS axis_low, least(14, ceil(max(value) OVER ())) AS axis_high FROM v""")
def _(spark, sf_dir):
    units = _rounded(A.implied_growth_units(fact_rows(spark, sf_dir)), "implied_high")
    out = X.implied_growth_steps(units)
    return _rounded(_rounded(out, "step", digits=9), "share_above").withColumns({c: F.col(c).cast("double") for c in ("axis_low", "axis_high")})


@add("exhibit_scores", f"""WITH {GOLD}, s AS (SELECT CASE f % 2 WHEN 0 THEN 'dev' ELSE 'holdout' END AS split, field, count(*) FILTER (WHERE NOT gone OR twice) AS tp, count(*) FILTER (WHERE twice AND NOT gone) AS fp, count(*) FILTER (WHERE gone AND NOT twice) AS fn FROM g GROUP BY 1, 2),
  m AS (SELECT split, field, 'precision' AS metric, tp, tp + fp AS n FROM s UNION ALL SELECT split, field, 'recall', tp, tp + fn FROM s), t AS (SELECT *, tp::DOUBLE / n AS p FROM m WHERE n > 0)
  SELECT split, field, metric, round(100 * p, 6) AS value, round(100 * greatest(0, {CENTRE} - {HALF}), 6) AS low, round(100 * least(1, {CENTRE} + {HALF}), 6) AS high FROM t""")
def _(spark, sf_dir):
    matches = E.match(*_gold(spark, sf_dir)).withColumn("split", F.when(F.substring("accession", 2, 20).cast("long") % 2 == 0, "dev").otherwise("holdout"))
    return _rounded(X.score_points(E.evaluate(matches, ["split", "field"])), "value", "low", "high")

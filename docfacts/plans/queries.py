"""Registered queries of the fact pipeline's operators, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import analytics as A
from ..operators import finalize as Z_
from ..operators import relational as R
from ..operators import resampling as B
from .fact_view import SQL as VIEW
from .fact_view import facts, yields

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TARGET = "SELECT *, (low + high) / 2 AS mid FROM facts WHERE subject = 'target' AND analysis = 'dcf' AND advisor NOT IN ('unattributed', 'joint')"
VALUES = f"{VIEW}, td AS ({TARGET}), vals AS (SELECT deal_id, advisor, median(mid) AS value FROM td WHERE field = 'discount_rate' GROUP BY 1, 2)"
PAIRS = f"{VALUES}, pairs AS (SELECT a.deal_id, a.advisor AS advisor_a, b.advisor AS advisor_b, a.value AS value_a, b.value AS value_b, abs(a.value - b.value) AS abs_diff FROM vals a JOIN vals b ON a.deal_id = b.deal_id AND a.advisor < b.advisor)"
UNITS = f"""{VIEW}, ex AS (SELECT * FROM facts WHERE field = 'exit_multiple' AND analysis = 'dcf' AND advisor NOT IN ('unattributed', 'joint')),
  im AS (SELECT row_number() OVER () AS g, accession, advisor, span_start, high, (low + high) / 2 AS mid FROM facts WHERE field = 'implied_growth'),
  near AS (SELECT DISTINCT ex.accession, ex.advisor, ex.subject, im.g, im.high, im.mid FROM ex JOIN im ON ex.accession = im.accession AND ex.advisor = im.advisor AND abs(ex.span_start - im.span_start) <= 6000),
  hits AS (SELECT accession, advisor, subject, max(high) AS implied_high, median(mid) AS implied_mid FROM near GROUP BY 1, 2, 3),
  units AS (SELECT u.*, implied_high, implied_mid, implied_high IS NOT NULL AS covered FROM (SELECT DISTINCT accession, advisor, subject FROM ex) u LEFT JOIN hits h ON u.accession = h.accession AND u.advisor = h.advisor AND u.subject = h.subject)"""
RATES = f"""{VIEW}, td AS ({TARGET}), disc AS (SELECT deal_id, median(mid) AS discount FROM td WHERE field = 'discount_rate' GROUP BY 1),
  gr AS (SELECT deal_id, median(mid) AS growth FROM td WHERE field = 'terminal_growth' GROUP BY 1),
  meta AS (SELECT deal_id, min(filing_date) AS filing_date, min(year) AS year, min(sic) AS sic, min(company) AS company FROM facts GROUP BY 1),
  m AS (SELECT meta.*, discount, growth FROM meta JOIN disc ON meta.deal_id = disc.deal_id LEFT JOIN gr ON meta.deal_id = gr.deal_id),
  rates AS (SELECT m.*, y.dgs10 AS y10, substr(sic, 1, 2) AS sic2, substr(sic, 1, 2) BETWEEN '60' AND '67' AS financial FROM m ASOF JOIN yields y ON m.filing_date >= y.date)"""
FLAGS = f"""{VIEW}, own AS (SELECT *, row_number() OVER () AS rid FROM facts),
  bad AS (SELECT DISTINCT unnest([g.rid, r.rid]) AS rid FROM own g JOIN own r ON g.accession = r.accession AND g.advisor = r.advisor AND g.subject = r.subject AND abs(g.span_start - r.span_start) <= 3000 WHERE g.field = 'terminal_growth' AND r.field = 'discount_rate' AND g.high >= r.low),
  each AS (SELECT o.*, list_sort(list_filter([
      CASE WHEN field = 'discount_rate' AND (low < 3 OR high > 25) THEN 'rate_atypical' WHEN field = 'terminal_growth' AND (low < -3 OR high > 6) THEN 'growth_atypical' WHEN field = 'implied_growth' AND (low < -5 OR high > 8) THEN 'growth_atypical' WHEN field IN ('exit_multiple', 'implied_multiple') AND (low < 1 OR high > 40) THEN 'multiple_atypical' END,
      CASE WHEN field = 'implied_growth' AND high > 4 THEN 'implied_growth_high' END,
      CASE WHEN b.rid IS NOT NULL THEN 'growth_ge_discount' END], lambda x: x IS NOT NULL)) AS fl FROM own o LEFT JOIN bad b ON o.rid = b.rid),
  flagged AS (SELECT * EXCLUDE (fl, rid), coalesce(array_to_string(fl, ';'), '') AS flags FROM each)"""
FACT_KEY = ["deal_id", "accession", "field", "low", "high", "advisor", "subject", "analysis", "span_start"]


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pairwise_differences(A.advisor_values(facts(spark, sf_dir), "discount_rate"))


@add("advisor_values", f"WITH {VALUES} SELECT deal_id, advisor, round(value, 6) AS value FROM vals")
def _(spark, sf_dir):
    return _rounded(A.advisor_values(facts(spark, sf_dir), "discount_rate"), "value")


@add("advisor_values_single", f"WITH {VIEW}, td AS ({TARGET}), d AS (SELECT DISTINCT deal_id, advisor, low, high, mid FROM td WHERE field = 'discount_rate') SELECT deal_id, advisor, round(max(mid), 6) AS value FROM d GROUP BY 1, 2 HAVING count(*) = 1")
def _(spark, sf_dir):
    return _rounded(A.advisor_values(facts(spark, sf_dir), "discount_rate", single_only=True), "value")


@add("pair_differences", f"WITH {PAIRS} SELECT deal_id, advisor_a, advisor_b, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(abs_diff, 6) AS abs_diff FROM pairs")
def _(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir), "value_a", "value_b", "abs_diff")


STATS = ["median_pp", "p25_pp", "p75_pp", "mean_pp", "share_ge_1pp", "share_ge_2pp", "max_pp"]


@add("pair_disagreement", f"""WITH {PAIRS} SELECT count(*) AS n_pairs, count(DISTINCT deal_id) AS n_deals, round(median(abs_diff), 6) AS median_pp, round(quantile_cont(abs_diff, 0.25), 6) AS p25_pp, round(quantile_cont(abs_diff, 0.75), 6) AS p75_pp,
  round(avg(abs_diff), 6) AS mean_pp, round(avg(CASE WHEN abs_diff >= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_ge_1pp, round(avg(CASE WHEN abs_diff >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_ge_2pp, round(max(abs_diff), 6) AS max_pp FROM pairs""")
def _(spark, sf_dir):
    return _rounded(A.disagreement(_pairs(spark, sf_dir)), *STATS)


@add("pair_histogram", f"WITH {PAIRS} SELECT CAST(floor(least(round(abs_diff, 6), 5 - 1e-9) / 0.5) AS BIGINT) AS bin, count(*) AS n FROM pairs GROUP BY 1")
def _(spark, sf_dir):
    return A.histogram(_rounded(_pairs(spark, sf_dir), "abs_diff"), "abs_diff", 0.5, 5.0)


@add("pair_ecdf", f"WITH {PAIRS}, r AS (SELECT round(abs_diff, 6) AS value FROM pairs) SELECT value, round(max(c), 6) AS share FROM (SELECT value, cume_dist() OVER (ORDER BY value) AS c FROM r) GROUP BY 1")
def _(spark, sf_dir):
    return _rounded(A.ecdf(_rounded(_pairs(spark, sf_dir), "abs_diff"), "abs_diff"), "share")


@add("implied_growth_units", f"WITH {UNITS} SELECT accession, advisor, subject, covered, round(implied_high, 6) AS implied_high, round(implied_mid, 6) AS implied_mid FROM units")
def _(spark, sf_dir):
    return _rounded(A.implied_growth_units(facts(spark, sf_dir)), "implied_high", "implied_mid").select("accession", "advisor", "subject", "covered", "implied_high", "implied_mid")


Z = NormalDist().inv_cdf(0.975)
CENTRE, HALF = f"((p + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n))", f"({Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n))"


@add("implied_growth_bounds", f"""WITH {UNITS}, b AS (SELECT unnest([3.0::DOUBLE, 4.0, 5.0, 6.0]) AS bound), s AS (SELECT bound, count(*) AS n, count(*) FILTER (WHERE implied_high > bound) AS k, count(*) FILTER (WHERE implied_mid > bound) AS k2 FROM units, b WHERE covered GROUP BY 1), t AS (SELECT *, k::DOUBLE / n AS p FROM s)
  SELECT bound, n AS n_covered, k AS high_above, k2 AS mid_above, round(p, 6) AS high_share, round(k2::DOUBLE / n, 6) AS mid_share, round(greatest(0, {CENTRE} - {HALF}), 6) AS high_lo, round(least(1, {CENTRE} + {HALF}), 6) AS high_hi FROM t""")
def _(spark, sf_dir):
    return _rounded(A.implied_growth_bounds(A.implied_growth_units(facts(spark, sf_dir))), "high_share", "mid_share", "high_lo", "high_hi")


@add("deal_rates", f"WITH {RATES} SELECT deal_id, filing_date, year, sic, company, round(discount, 6) AS discount, round(growth, 6) AS growth, y10, sic2, financial FROM rates")
def _(spark, sf_dir):
    return _rounded(A.deal_rates(facts(spark, sf_dir), yields(spark, sf_dir)), "discount", "growth")


@add("market_by_year", f"""WITH {RATES} SELECT year, count(*) AS n, round(median(discount), 6) AS discount_median, round(quantile_cont(discount, 0.25), 6) AS discount_q25, round(quantile_cont(discount, 0.75), 6) AS discount_q75, round(median(growth), 6) AS growth_median, count(growth) AS growth_n, round(avg(y10), 6) AS y10_mean FROM rates WHERE NOT financial GROUP BY 1""")
def _(spark, sf_dir):
    return _rounded(A.market_by_year(A.deal_rates(facts(spark, sf_dir), yields(spark, sf_dir))), "discount_median", "discount_q25", "discount_q75", "growth_median", "y10_mean")


@add("pooled_slope", f"WITH {RATES} SELECT count(*) AS n, round(regr_slope(discount, y10), 6) AS slope FROM rates WHERE NOT financial")
def _(spark, sf_dir):
    return _rounded(A.slope(A.deal_rates(facts(spark, sf_dir), yields(spark, sf_dir)).where("NOT financial"), "discount"), "slope")


@add("fixed_effects_slope", f"""WITH {RATES}, w AS (SELECT sic2, y10 - avg(y10) OVER (PARTITION BY sic2) AS x, discount - avg(discount) OVER (PARTITION BY sic2) AS v, count(*) OVER (PARTITION BY sic2) AS c FROM rates WHERE NOT financial) SELECT count(*) AS n, round(sum(x * v) / sum(x * x), 6) AS slope FROM w WHERE c > 1""")
def _(spark, sf_dir):
    return _rounded(A.slope(A.deal_rates(facts(spark, sf_dir), yields(spark, sf_dir)).where("NOT financial"), "discount", fixed_effects=True), "slope")


@add("advisor_table", f"""WITH {VIEW}, td AS ({TARGET} AND NOT substr(sic, 1, 2) BETWEEN '60' AND '67'), d AS (SELECT advisor, count(DISTINCT deal_id) AS deals, round(median(mid), 6) AS discount_median FROM td WHERE field = 'discount_rate' GROUP BY 1 ORDER BY deals DESC, advisor LIMIT 5), g AS (SELECT advisor, round(median(mid), 6) AS growth_median FROM td WHERE field = 'terminal_growth' GROUP BY 1) SELECT d.*, growth_median FROM d LEFT JOIN g ON d.advisor = g.advisor""")
def _(spark, sf_dir):
    return _rounded(A.advisor_table(facts(spark, sf_dir), top=5), "discount_median", "growth_median")


def _flags(spark, sf_dir):
    return A.flags(facts(spark, sf_dir), FACT_KEY)


@add("soft_flags", f"WITH {FLAGS} SELECT deal_id, accession, field, low, high, advisor, subject, analysis, span_start, flags FROM flagged")
def _(spark, sf_dir):
    return _flags(spark, sf_dir).select(*FACT_KEY, "flags")


@add("flag_histogram", f"WITH {FLAGS} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM flagged) WHERE flag <> '' GROUP BY 1")
def _(spark, sf_dir):
    return A.flag_histogram(_flags(spark, sf_dir))


@add("corpus_counts", f"WITH {VIEW} SELECT field, CASE WHEN field IN ('value_per_share') THEN 'auxiliary' ELSE 'core' END AS tier, year, count(*) AS n, count(DISTINCT deal_id) AS deals, round(avg(CASE WHEN advisor = 'unattributed' THEN 1.0::DOUBLE ELSE 0 END), 6) AS unattributed FROM facts GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.groupBy("field", E.tier(F.col("field")).alias("tier"), "year").agg(F.count("*").alias("n"), F.count_distinct("deal_id").alias("deals"), F.round(F.avg((F.col("advisor") == "unattributed").cast("double")), 6).alias("unattributed"))


@add("implied_perpetuity_growth", """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity * l_extendedprice * r - l_extendedprice) / (l_quantity * l_extendedprice + l_extendedprice), 8) AS growth_end, round((l_quantity * l_extendedprice * r - l_extendedprice * sqrt(1 + r)) / (l_quantity * l_extendedprice + l_extendedprice * sqrt(1 + r)), 8) AS growth_mid FROM (SELECT *, CASE WHEN l_discount > 0 THEN l_discount END AS r FROM lineitem)""")
def _(spark, sf_dir):
    rows, c = _read(spark, sf_dir, "lineitem"), F.col
    growth = lambda t: F.round(E.implied_perpetuity_growth(c("l_quantity"), c("l_extendedprice"), c("l_extendedprice"), c("l_discount"), t), 8)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", growth("end").alias("growth_end"), growth("mid").alias("growth_mid"))


@add("deal_sessions", """WITH g AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
  SELECT o_orderkey, o_custkey, CAST(sum(CASE WHEN d - p > 270 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY d RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def _(spark, sf_dir):
    return R.sessions(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 270, "session").select("o_orderkey", "o_custkey", "session")


@add("deal_ids", """WITH g AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
  s AS (SELECT *, sum(CASE WHEN d - p > 270 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY d RANGE UNBOUNDED PRECEDING) AS session FROM g)
  SELECT o_custkey, arg_min(o_orderkey, (d, o_orderkey)) AS deal_id, count(*) AS filings, min(d) AS first_date, max(d) AS last_date FROM s GROUP BY o_custkey, session""")
def _(spark, sf_dir):
    s = R.sessions(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 270, "session")
    day = F.col("o_orderdate").cast("date")
    return s.groupBy("o_custkey", "session").agg(F.min(F.struct(day, "o_orderkey"))["o_orderkey"].alias("deal_id"), F.count("*").alias("filings"), F.min(day).alias("first_date"), F.max(day).alias("last_date")).drop("session")


@add("asof_yield", f"WITH {VIEW} SELECT o_orderkey, dgs10 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) o ASOF LEFT JOIN yields y ON o.d >= y.date")
def _(spark, sf_dir):
    return R.as_of_join(_read(spark, sf_dir, "orders"), yields(spark, sf_dir), "o_orderdate", "date", "dgs10").select("o_orderkey", "dgs10")


@add("asof_last_click", "WITH c AS (SELECT user_id, event_id AS click_id, ts AS t FROM events WHERE event_type = 'click'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click') SELECT event_id, click_id FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts > c.t")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("t"))
    return R.as_of_by_key(e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "t", ["click_id"]).select("event_id", "click_id")


@add("band_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(a.event_id - b.event_id) <= 300")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("a_id"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"))
    return R.band_pairs(a, b, ["user_id"], "a_id", "b_id", 300).select("a_id", "b_id")


@add("dedupe_first_filing", f"""WITH {VIEW}, k AS (SELECT *, row_number() OVER (PARTITION BY deal_id, field, advisor, subject, analysis ORDER BY filing_date, accession, span_start, low, high) AS rn FROM facts), c AS (SELECT deal_id, field, advisor, subject, analysis, count(DISTINCT accession) AS n_filings FROM facts GROUP BY 1, 2, 3, 4, 5)
  SELECT k.deal_id, k.field, k.advisor, k.subject, k.analysis, accession, low, high, span_start, n_filings FROM k JOIN c ON k.deal_id = c.deal_id AND k.field = c.field AND k.advisor = c.advisor AND k.subject = c.subject AND k.analysis = c.analysis WHERE rn = 1""")
def _(spark, sf_dir):
    key = ["deal_id", "field", "advisor", "subject", "analysis"]
    out = R.keep_first(facts(spark, sf_dir), key, ["filing_date", "accession", "span_start", "low", "high"], "accession", "n_filings")
    return out.select(*key, "accession", "low", "high", "span_start", "n_filings")


@add("rejection_reasons", f"WITH {VIEW} SELECT reason, field, count(*) AS n FROM (SELECT field, CASE WHEN low > high - 1 THEN 'reversed_range' WHEN (field = 'discount_rate' AND (low * 6 < 0 OR high - 1 > 60)) OR (field = 'terminal_growth' AND high - 1 > 5) THEN 'outside' END AS reason FROM facts) WHERE reason IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    f = facts(spark, sf_dir)
    high = F.col("high") - 1
    reason = F.when(F.col("low") > high, "reversed_range").when(((F.col("field") == "discount_rate") & ((F.col("low") * 6 < 0) | (high > 60))) | ((F.col("field") == "terminal_growth") & (high > 5)), "outside")
    return f.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason", "field").agg(F.count("*").alias("n"))


@add("wilson_by_source", f"""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1), t AS (SELECT *, k::DOUBLE / n AS p FROM s) SELECT source, n, k, round(greatest(0, {CENTRE} - {HALF}), 6) AS lo, round(least(1, {CENTRE} + {HALF}), 6) AS hi FROM t""")
def _(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id")
    s = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("k"))
    lo, hi = E.wilson_interval(F.col("k"), F.col("n"))
    return s.select("source", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@add("precision_recall", """WITH p AS (SELECT lang, n_chars > 2000 AS said, quality = 1 AS good FROM documents JOIN labels ON documents.doc_id = labels.doc_id), s AS (SELECT lang, count(*) FILTER (WHERE said AND good) AS tp, count(*) FILTER (WHERE said AND NOT good) AS fp, count(*) FILTER (WHERE good AND NOT said) AS fn FROM p GROUP BY 1)
  SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM s""")
def _(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    said, true = F.col("n_chars") > 2000, F.col("quality") == 1
    n = lambda x: F.sum(x.cast("long"))
    s = rows.groupBy("lang").agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(true & ~said).alias("fn"))
    p, r, f = E.scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("lang", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@add("text_fingerprint", "SELECT doc_id, sha256(text) AS doc_sha256, length(text) AS n_chars FROM documents")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", E.fingerprint(F.col("text")).alias("doc_sha256"), F.length("text").cast("long").alias("n_chars"))


@add("collapse_space", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(E.collapse(F.col("text"))).alias("collapsed"))


@add("quote_location", "SELECT doc_id, strpos(text, substr(text, 41, 30)) - 1 AS start, (length(text) - length(replace(text, substr(text, 41, 30), ''))) // 30 AS occurrences FROM documents WHERE length(text) >= 70")
def _(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where(F.length("text") >= 70).withColumn("quote", F.substring("text", 41, 30))
    times = (F.length("text") - F.length(F.replace(F.col("text"), F.col("quote"), F.lit("")))) / 30
    return d.select("doc_id", (F.instr("text", F.col("quote")).cast("long") - 1).alias("start"), times.cast("long").alias("occurrences"))


@add("stratified_round_robin", "WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS turn FROM orders) SELECT o_orderkey, t.o_orderpriority FROM t JOIN s ON t.o_orderpriority = s.o_orderpriority ORDER BY turn, n DESC, t.o_orderpriority LIMIT 23")
def _(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.round_robin(rows, "o_orderpriority", 23, "o_orderkey", shuffle=F.md5(F.col("o_orderkey").cast("string")))


@add("deal_view", f"""WITH {VIEW}, r AS (SELECT *, row_number() OVER w2 AS rn, count(*) OVER w1 - 1 AS more FROM facts WINDOW w1 AS (PARTITION BY deal_id, subject, analysis, advisor, field), w2 AS (PARTITION BY deal_id, subject, analysis, advisor, field ORDER BY span_start, low, high)),
  c AS (SELECT *, CAST(round(low, 4) AS VARCHAR) || '-' || CAST(round(high, 4) AS VARCHAR) || CASE WHEN more > 0 THEN ' +' || more ELSE '' END AS cell FROM r WHERE rn = 1)
  SELECT deal_id, subject, analysis, advisor, max(CASE WHEN field = 'discount_rate' THEN cell END) AS discount_rate, max(CASE WHEN field = 'terminal_growth' THEN cell END) AS terminal_growth FROM c WHERE field IN ('discount_rate', 'terminal_growth') GROUP BY 1, 2, 3, 4""")
def _(spark, sf_dir):
    f = _rounded(facts(spark, sf_dir), "low", "high", digits=4).where(F.col("field").isin("discount_rate", "terminal_growth"))
    return Z_.deal_view(f, ["discount_rate", "terminal_growth"])


@add("find_deal", f"WITH {VIEW} SELECT deal_id FROM facts WHERE company ILIKE '%000000007%' GROUP BY 1 ORDER BY count(*) DESC, deal_id LIMIT 1")
def _(spark, sf_dir):
    f = facts(spark, sf_dir)
    filings = f.select("deal_id", "accession", "company", F.col("filing_date").alias("file_date")).distinct().withColumn("tickers", F.array().cast("array<string>"))
    return Z_.find_deal(filings, f, "000000007")


@add("bootstrap_median")
def _(spark, sf_dir):
    return B.bootstrap_median(_pairs(spark, sf_dir))


@add("bootstrap_slope")
def _(spark, sf_dir):
    return A.block_bootstrap_slope(A.deal_rates(facts(spark, sf_dir), yields(spark, sf_dir)).where("NOT financial"), "discount")


@add("bootstrap_growth_slope")
def _(spark, sf_dir):
    return A.block_bootstrap_slope(A.deal_rates(facts(spark, sf_dir), yields(spark, sf_dir)).where("NOT financial"), "growth")

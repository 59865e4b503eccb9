"""From judged values to the released fact table: de-duplication, ids, flags, deal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import CORE_FIELDS, fact_id, tier
from ..sources.tables import FACT_COLUMNS
from .analytics import flags


def finalize(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """The released table from facts of ``extract`` (accession, ...) without rejected values.

    ``filings``: (accession, deal_id, cik, company, sic, file_date). The same value of a deal in several filings stays once,
    in the first of them, with n_filings; spans decide between equal rows. Columns are those of the format in its order. No text is read or carried but snippets.
    """
    rows = facts.drop("n", "problems", "reason", "sentence").join(filings.select("accession", "deal_id", "cik", "company", "sic", F.col("file_date").alias("filing_date")), "accession")
    key = ["deal_id", "field", "low", "high", "unit", "advisor", "subject", "analysis", "metric", "valuation_date"]
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct("filing_date", "accession", "start", "end", F.struct(*others).alias("r"))).alias("m"), F.count_distinct("accession").alias("n_filings"))
    kept = first.select(*key, "m.r.*", "n_filings").withColumnsRenamed({"start": "span_start", "end": "span_end"})
    flagged = flags(kept, ["accession", "field", "span_start", "span_end", "low", "high", "advisor", "subject"])
    same = (F.col("low") == F.col("high")) & (F.col("raw_low") == F.col("raw_high"))
    out = flagged.withColumns({"fact_id": fact_id(F.col("accession"), F.col("field"), F.col("span_start")), "tier": tier(F.col("field")), "is_point": same, "year": F.year(F.to_date("filing_date"))})
    return out.select(*[c.split()[0] for c in FACT_COLUMNS.replace("\n", " ").split(", ")])


def find_deal(filings: DataFrame, facts: DataFrame, query: str) -> DataFrame:
    """(deal_id): the deal of an accession or deal id, else of a ticker, else of a company's name in part.

    Of several the one with most facts, ties to the smaller id; deals without facts come last, latest filing first.
    """
    q = F.lit(query)
    level = F.when((F.col("accession") == q) | (F.col("deal_id") == q), 0).when(F.array_contains(F.transform("tickers", F.upper), F.upper(q)), 1).when(F.contains(F.lower("company"), F.lower(q)), 2)
    hits = filings.withColumn("level", level).where("level IS NOT NULL").groupBy("deal_id").agg(F.min("level").alias("level"), F.max("file_date").alias("last"))
    counts = facts.groupBy("deal_id").agg(F.count("*").alias("n"))
    ranked = hits.join(counts, "deal_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.orderBy("level", F.desc("n"), F.when(F.col("n") == 0, F.col("last")).desc(), "deal_id").limit(1).select("deal_id")


def deal_view(facts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row for each deal, subject, analysis and advisor; a column for each field: its first range by position, ``+n`` for n more."""
    w = Window.partitionBy("deal_id", "subject", "analysis", "advisor", "field")
    cell = F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"))
    own = facts.withColumn("more", F.count("*").over(w) - 1).withColumn("rn", F.row_number().over(w.orderBy("span_start", "low", "high"))).where("rn = 1")
    shown = own.withColumn("cell", F.when(F.col("more") > 0, F.concat(cell, F.lit(" +"), F.col("more").cast("string"))).otherwise(cell))
    return shown.groupBy("deal_id", "subject", "analysis", "advisor").pivot("field", fields or CORE_FIELDS).agg(F.first("cell"))


#: Order of a deal's blocks, and analyses that make a block only beside a discount rate.
SUBJECTS = ["target", "acquirer", "pro_forma", "unspecified"]
BLOCKS, LOOSE = ["dcf", "ddm", "pv_future_price", "nav", "other", "unspecified", ""], ["other", "unspecified", ""]
#: Rows of a block.
ROWS = [*CORE_FIELDS, "value_per_share"]


def deal_blocks(facts: DataFrame) -> DataFrame:
    """(deal_id, subject, analysis, field, place, cells): the view of deals with advisors side by side.

    A block is a subject and an analysis of a deal; loose analyses make one only with a discount rate. ``cells`` is an array of (advisor, cell) for all
    advisors of the block, unattributed last, with a null cell where one has no such value; ``place`` orders blocks and rows within a deal. A
    cell is the first range by position, ``+n`` for n more. All facts of a deal's block meet in one task; they are bounded by its filings.
    """
    number = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    own = facts.where(F.col("field").isin(ROWS) & F.col("subject").isin(SUBJECTS) & F.col("analysis").isin(BLOCKS))
    block = ["deal_id", "subject", "analysis"]
    text = F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"))
    cells = own.groupBy(*block, "field", "advisor").agg(F.count("*").alias("n"), F.min(F.struct("span_start", "low", "high", text.alias("cell")))["cell"].alias("cell"))
    shown = F.when(F.col("n") > 1, F.concat("cell", F.lit(" +"), (F.col("n") - 1).cast("string"))).otherwise(F.col("cell"))
    whole = cells.withColumn("cell", shown).groupBy(*block).agg(F.collect_list(F.struct("field", "advisor", "cell")).alias("c"))
    names = F.array_sort(F.array_distinct(F.transform("c", lambda x: F.struct((x["advisor"] == "unattributed").alias("last"), x["advisor"].alias("advisor")))))
    rated = F.exists("c", lambda x: x["field"] == "discount_rate")
    whole = whole.where(~F.col("analysis").isin(LOOSE) | rated).withColumn("names", names)
    rows = whole.withColumn("field", F.explode(F.array_distinct(F.transform("c", lambda x: x["field"]))))
    of = F.transform("names", lambda a: F.struct(a["advisor"].alias("advisor"), F.get(F.filter("c", lambda x: (x["field"] == F.col("field")) & x["advisor"].eqNullSafe(a["advisor"])), F.lit(0))["cell"].alias("cell")))
    place = F.array(number(SUBJECTS, "subject"), number(BLOCKS, "analysis"), number(ROWS, "field"))
    return rows.select(*block, "field", place.alias("place"), of.alias("cells"))

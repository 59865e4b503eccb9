"""Verification of a stored fact table against the texts it was read from.

Nothing of the extraction's own cutting is trusted: spans and snippets are cut anew out of the stored texts, digests are taken
anew, and each span alone is read again by the lexer and the grammar and must state the fact's field and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .durable import written
from .extraction import stated
from .lexing import lexemes

#: Fields whose spans state dollars, and what one unit of them is.
MONEY = {"value_per_share": 1.0, "offer_price": 1.0, "fee_total": 1e6, "fee_opinion": 1e6, "fee_contingent": 1e6}
#: Whole-document problems; a document's facts share them, and none of its spans is looked at.
MISSING, CHANGED = "document_missing", "document_changed"
#: A span that many facts share is read again for each so many parts of them, so that none of it is one task's.
PARTS = 16


def save_by_document(df: DataFrame, table: str, buckets: int) -> None:
    """Saves facts or texts as a table bucketed and sorted by accession, so that their join needs no shuffle.

    Both tables need the same number of buckets; a bucket should hold what a task can sort, about a gigabyte.
    """
    df.write.bucketBy(buckets, "accession").sortBy("accession").mode("overwrite").saveAsTable(table)


def _cut(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Facts with their document's state and with span and snippet cut out of its text; the text itself goes no further."""
    docs = texts.select("accession", F.col("text").cast("string").alias("__text"), F.lit(True).alias("__there"))
    # once a document, not once a fact
    docs = docs.withColumn("__digest", E.fingerprint(F.coalesce("__text", F.lit(""))))
    rows = facts.join(docs, "accession", "left")
    n = F.length("__text")
    cut = lambda a, b: F.substr("__text", F.col(a) + 1, F.col(b) - F.col(a))
    in_text = (F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= n)
    around = (F.col("snippet_start") >= 0) & (F.col("snippet_start") <= F.col("span_start")) & (F.col("span_end") <= F.col("snippet_end")) & (F.col("snippet_end") <= n)
    state = F.when(F.col("__there").isNull(), MISSING).when(~F.col("__digest").eqNullSafe(F.col("doc_sha256")), CHANGED)
    return rows.withColumns({
        "__state": state, "__in": F.coalesce(in_text, F.lit(False)), "__around": F.coalesce(around, F.lit(False)),
        "__span": F.when(in_text, cut("span_start", "span_end")), "__snippet": F.when(around, E.collapse(cut("snippet_start", "snippet_end"))),
    }).drop("__text", "__there", "__digest")


def _read_again(spans: DataFrame, *key: str) -> DataFrame:
    """(key, __read array of (field, low, high)): what the lexer and the grammar read in a span alone; money in dollars as field ``usd``. One pass over the spans."""
    rows = stated(lexemes(spans, "__span", *key, by=key), *key)
    rates = F.collect_list(F.when(F.col("c").isNotNull(), F.struct("field", "low", "high")))
    paid = F.when(F.col("kind").isin("usd", "usd_range"), F.struct("start", F.when(F.col("kind") == "usd", F.array("low")).otherwise(F.array("low", "high")).alias("v")))
    found = rows.groupBy(*key).agg(rates.alias("__rates"), F.flatten(F.transform(F.array_sort(F.collect_list(paid)), lambda s: s["v"])).alias("__ends"))
    first, second = F.get("__ends", F.lit(0)), F.get("__ends", F.lit(1))
    money = F.array_compact(F.array(F.when(first.isNotNull(), F.struct(F.lit("usd").alias("field"), first.alias("low"), F.coalesce(second, first).alias("high")))))
    return found.select(*key, F.concat("__rates", money).alias("__read"))


def verify_release(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``facts`` with ``problems``: what keeps each from being proven by its text; an empty list is a proven fact.

    ``facts``: fact_id, accession, field, low, high, raw ends, span and snippet bounds, snippet, doc_sha256; ``texts``: accession,
    text, one row each. Problems of a document: it is missing (``document_missing``), or its text is not the one that the facts
    were read from (``document_changed``, where any fact of it has another digest). Else, of a fact: ``span_out_of_range`` alone, or any of
    ``snippet_does_not_contain_span``, ``snippet_not_verbatim``, ``snippet_too_long``, ``value_text_not_in_span`` and ``value_not_reproduced``.

    Facts are joined with texts once on accession, without a shuffle where both are tables of ``save_by_document``; only cut spans
    of at most a few hundred characters are read again, equal ones together. Repeated facts are each judged; null bounds are out of range; a null text is an empty
    one. No fact gives an empty result.
    """
    # the join leaves a document's facts together; they are read twice below, without their text
    part = F.pmod(F.xxhash64("fact_id"), F.lit(PARTS)).cast("int")
    rows = written(_cut(facts, texts).withColumns({"__document": F.max("__state").over(Window.partitionBy("accession")), "__slice": part}), "verify")
    ready = F.col("__document").isNull() & F.col("__in")
    # what a span says hangs on nothing but its text
    spans = rows.where(ready).select("__span", "__slice").distinct()
    rows = rows.join(_read_again(spans, "__span", "__slice"), ["__span", "__slice"], "left")
    unit = F.coalesce(*[F.when(F.col("field") == f, F.lit(u)) for f, u in MONEY.items()])
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    rate = F.exists("__read", lambda r: (r["field"] == F.col("field")) & (r["low"] == F.col("low")) & (r["high"] == F.col("high")))
    # a point is stated by the first amount of its span, a range by the first two
    money = F.exists("__read", lambda r: (r["field"] == "usd") & near(r["low"] / unit, F.col("low")) & ((F.col("low") == F.col("high")) | near(r["high"] / unit, F.col("high"))))
    stated = F.coalesce(F.when(unit.isNull(), rate).otherwise(money), F.lit(False))
    of_fact = F.array_compact(F.array(
        F.when(~F.col("__around"), "snippet_does_not_contain_span").when(~F.col("__snippet").eqNullSafe(F.col("snippet")), "snippet_not_verbatim"),
        F.when(F.length("snippet") > E.SNIPPET, "snippet_too_long"),
        F.when(~F.coalesce(F.contains("__span", "raw_low") & F.contains("__span", "raw_high"), F.lit(False)), "value_text_not_in_span"),
        F.when(~stated, "value_not_reproduced"),
    ))
    problems = F.when(F.col("__document").isNotNull(), F.array("__document")).when(~F.col("__in"), F.array(F.lit("span_out_of_range"))).otherwise(of_fact)
    return rows.withColumn("problems", problems).select(*facts.columns, "problems")


def verification_report(verified: DataFrame) -> DataFrame:
    """One row: checked, verified, missing, changed, span_mismatch, and ok where there are facts and all are proven."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    proven, missing, changed = F.size("problems") == 0, F.array_contains("problems", MISSING), F.array_contains("problems", CHANGED)
    out = verified.agg(F.count("*").alias("checked"), n(proven).alias("verified"), n(missing).alias("missing"), n(changed).alias("changed"), n(~proven & ~missing & ~changed).alias("span_mismatch"))
    return out.withColumn("ok", (F.col("checked") > 0) & (F.col("checked") == F.col("verified")))

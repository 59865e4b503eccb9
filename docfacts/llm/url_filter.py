"""URL filtering by curated rules and by association rules mined from labelled URLs.

Method. A URL becomes a set of tokens (host labels, top domain, path words, file ending, query keys; numbers are
masked). Spark FP-growth mines the token sets of blocked URLs; their confidence is counted over all labelled URLs by the
inverted index that judges pages later: a rule is listed under its rarest token, so a URL is only tested against
rules that share that token. Sets with enough support, confidence and lift are rules; a rule goes if a part of it is as
confident. No rule is cut by number or length. A curated rule (host and path prefix, the longest that fits) has the last word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

BLOCK, ALLOW = "block", "allow"

#: Mined rules need this share of the blocked URLs, this many of them, this share of their URLs blocked, and that share over
#: the overall one. With a share as the bound, the frequent tokens are at most a URL's tokens / MIN_SUPPORT at every size.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT = 0.01, 20, 0.6, 1.5
#: Ways that the rows of one URL are dealt over tasks.
SPREAD = 16

Rule = tuple[str, str, str]  # verdict, host, path prefix


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """``rule`` (host and path as one string) or ``verdict`` of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, h + p if what == "rule" else verdict).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; empty for a null url."""
    host, path = host_of(url), path_of(url)
    masked = F.regexp_replace(F.lower(path), "[0-9]+", "#")
    labels = F.split(host, r"\.")
    words = F.filter(F.split(F.regexp_replace(masked, r"\.[a-z#]{1,5}$", ""), r"[/._-]+"), lambda w: (w != "") & (w != "#"))
    ending = F.regexp_extract(masked, r"\.([a-z#]{1,5})$", 1)
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda k: k != ""), lambda k: F.substring_index(k, "=", 1))
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind + ":"), x))
    every = F.concat(
        named("host", F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != "")),
        named("top", F.filter(F.slice(labels, -1, 1), lambda x: x != "")),
        named("path", words),
        named("end", F.filter(F.array(ending), lambda x: x != "")),
        named("key", keys),
    )
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


@dataclass(frozen=True)
class Rules:
    """Mined rules (need, first, confidence) and ``same``: tokens that always come together, each with the one that stands for it."""

    index: DataFrame | None
    same: dict[str, str]

    def items(self, t: Column) -> Column:
        if not self.same:
            return t
        of = F.create_map(*[F.lit(x) for pair in self.same.items() for x in pair])
        return F.array_distinct(F.transform(t, lambda x: F.coalesce(F.try_element_at(of, x), x)))


def holding(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (any columns and t, an array of tokens) beside each of ``sets`` (need, first, ...) whose tokens they have."""
    return rows.withColumn("first", F.explode("t")).join(sets, "first").where(F.size(F.array_intersect("need", "t")) == F.size("need"))


def mine(labelled: DataFrame, scratch: Scratch) -> Rules:
    """Rules from (url, bad boolean).

    Tokens that occur in the same labelled URLs, such as those of one site, are one item, so that sets of them are not
    enumerated. Only tokens of MIN_SUPPORT of the blocked URLs come to the driver.
    """
    rows = scratch.table(labelled.where("bad IS NOT NULL AND url IS NOT NULL").select(tokens(F.col("url")).alias("t"), "bad", F.xxhash64("url").alias("h")))
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")).first()
    if not n["bad"]:
        return Rules(None, {})
    least = max(MIN_SUPPORT * n["bad"], MIN_ROWS)
    # rows with the same fingerprint hold the same tokens
    each = rows.select(F.explode("t").alias("token"), "bad", "h").groupBy("token").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    frequent = each.where(F.col("bad") >= least).groupBy("n", "bad", "h").agg(F.array_sort(F.collect_set("token")).alias("tokens")).collect()
    if not frequent:
        return Rules(None, {})
    same = {t: r["tokens"][0] for r in frequent for t in r["tokens"][1:]}
    seen = {r["tokens"][0]: r["n"] for r in frequent}
    known = Rules(None, same).items(F.col("t"))
    rows = scratch.table(rows.select(F.array_intersect(known, F.array(*map(F.lit, sorted(seen)))).alias("t"), "bad"))
    model = FPGrowth(itemsCol="t", minSupport=min(1.0, least / n["bad"]), minConfidence=1.0).fit(rows.where("bad").select("t"))
    rarity = F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])
    first = F.array_min(F.transform("need", lambda x: F.struct(rarity[x].alias("n"), x.alias("token"))))["token"]
    sets = scratch.table(model.freqItemsets.select(F.array_sort("items").alias("need"), F.col("freq").alias("blocked")).withColumn("first", first))
    total = holding(sets.select("need", "first"), rows).groupBy("need").agg(F.count("*").alias("total"))
    floor = max(MIN_CONFIDENCE, min(1.0, MIN_LIFT * n["bad"] / n["n"]))
    rules = sets.join(total, "need").withColumn("confidence", F.col("blocked") / F.col("total")).where(F.col("confidence") >= floor)
    rules = scratch.table(rules.select("need", "first", "confidence"))
    parts = rules.select(F.col("need").alias("part"), "first", F.col("confidence").alias("part_confidence"))
    whole = rules.select(F.col("need").alias("t"), "confidence").withColumn("first", F.explode("t")).join(parts, "first")
    whole = whole.where((F.size("part") < F.size("t")) & (F.size(F.array_intersect("part", "t")) == F.size("part")) & (F.col("part_confidence") >= F.col("confidence")))
    return Rules(scratch.table(rules.join(whole.select(F.col("t").alias("need")).distinct(), "need", "left_anti")), same)


def url_filter(spark: SparkSession, pages: DataFrame, labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) for each page (page_id, url).

    ``labelled``: (url, bad boolean). A curated rule that fits decides; else a page is blocked if a mined rule holds all
    whose tokens it has, of which the most confident is returned in ``mined`` (of equal ones the last by its tokens); else it
    is allowed. Null urls or urls without ``://`` have an empty host and path. Null page_id and repeated rows are judged
    each, very long urls whole; an empty table gives an empty result. Other columns are not read.
    """
    found = mine(labelled, Scratch(spark, "urls"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    none = {"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}
    if found.index is None or found.index.isEmpty():
        judged = rows.withColumns(none)
    else:
        urls = rows.where("url IS NOT NULL").select("url").distinct().withColumn("t", found.items(tokens(F.col("url"))))
        best = holding(found.index, urls).groupBy("url").agg(F.max(F.struct("confidence", F.array_join("need", " ").alias("mined"))).alias("best"))
        # a url may be a third of all rows: its rows are dealt over tasks, its one verdict repeated for each
        best = best.select("url", "best.*").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        part = F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("int")
        judged = rows.where("url IS NOT NULL").withColumn("part", part).join(best, ["url", "part"], "left").drop("part")
        judged = judged.select("page_id", "url", "mined", "confidence").unionByName(rows.where("url IS NULL").withColumns(none))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = judged.select("page_id", host.alias("host"), path.alias("path"), "mined", "confidence")
    rule, verdict = (curated(rules, F.col("host"), F.col("path"), w) for w in ("rule", "verdict"))
    by_method = F.when(F.col("mined").isNotNull(), BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "mined", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages of labelled documents; bad if the document is toxic or of low quality.

    A page belongs to the document whose doc_id is the number in its path: its html is that document's text as a web page.
    (Traced by shared shingles on sf0.1: of 2,467 pages whose text is found in a document, 2,259 have it under that
    number, and the others under a copy's.)
    """
    doc = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/(?:[a-z]+/)*([0-9]{1,18})', 1) AS bigint)")
    bad = F.max((F.col("toxic") == 1) | (F.col("quality") == 0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(bad.alias("bad"))
    return pages.where("url IS NOT NULL").select("url", doc.alias("doc")).join(known, "doc").select("url", "bad")

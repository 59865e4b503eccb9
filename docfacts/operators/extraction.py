"""Values in context: which field a value states, by whom, of what, in what analysis. Windows over lexemes of a document.

All windows run over a document in the order of its text, so one shuffle and one sort serve them; no step joins, and none reads
the text again, since values carry what stands around them.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.lexicon import CUES as LEX_CUES
from . import parties as P
from .lexing import dealt, lexemes
from .sections import REACH, majority, with_heading_kind

CUES = ["discount", "growth", "exit"]
FIELD = {"discount": "discount_rate", "growth": "terminal_growth", "exit": "exit_multiple"}
#: Fields whose values need an analysis, and those whose analysis must be of discounting.
VALUATION = ["discount_rate", "terminal_growth", "exit_multiple", "implied_growth", "implied_multiple"]
DCF_LIKE = ["dcf", "ddm", "pv_future_price", "nav"]
#: Look-backs in characters: cue to value, analysis, house, any mark of an analysis, party.
CUE_REACH, ANALYSIS_REACH, HOUSE_REACH, MARK_REACH, SUBJECT_REACH = 200, 12000, 3500, 6000, 2500
#: A sentence is looked at so far from a value for its party; a paragraph's first characters may say pro forma.
SENTENCE_REACH, PARAGRAPH = 700, 90
# Words that may stand between a value and a cue after it, and between members of a list.
ADJECTIVES = ["after tax", "after-tax", "annual", "applied", "assumed", "equity", "estimated", "illustrative", "nominal", "pre tax", "pre-tax", "pro forma", "selected"]
BEFORE_CUE = rf"(?i)^\s*,?\s*(?:(?:{'|'.join(a.replace(' ', '[ ]+') for a in ADJECTIVES)})\s+)*$"
LISTED = r"(?i)^\s*(?:(?:,|and|or)\s*)+$"
#: After a single value: the border of a table's cell, or a second percentage.
CELL = r"^\s*\||^\s+[0-9.]+\s*%"
#: Between "implied" and a cue.
FILLERS = rf"(?i)^\s+(?:(?:{'|'.join(sorted(LEX_CUES['fillers'], key=len, reverse=True))})\s+){{0,4}}$"
ORDER = ["line", "sentence", "start", "n"]


def _unit(kind: Column) -> Column:
    return F.replace(kind, F.lit("_range"), F.lit(""))


def _windows(*doc: str):
    """(document, sentence, whole sentence) in the order of the text."""
    d = Window.partitionBy(*doc).orderBy(*ORDER)
    s = Window.partitionBy(*doc, "line", "sentence").orderBy("start", "n")
    return d, s, s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


#: Columns by the stage at which all that they read is there; windows of one stage and order are one operator.
Stages = list[dict[str, Column]]


def _staged(rows: DataFrame, *families: Stages) -> DataFrame:
    """Rows with the columns of all families, stage by stage: every operator copies whole rows, so there are as few as can be."""
    for stage in zip_longest(*families, fillvalue={}):
        rows = rows.withColumns({k: c for family in stage for k, c in family.items()})
    return rows


def _last_house(d) -> Column:
    return F.last(F.when(F.col("kind") == "house", F.struct("start", "name")), ignorenulls=True).over(d.rowsBetween(Window.unboundedPreceding, -1))


def _marked(*doc: str) -> Stages:
    """What a lexeme's neighbours say of it: all columns that valuations read."""
    d, _, _ = _windows(*doc)
    is_cue = F.col("kind").isin(CUES)
    is_value = F.col("low").isNotNull() & F.col("kind").isin("pct", "pct_range", "x", "x_range")
    # cues, values and the words that turn them are what a value's neighbours can be
    part = is_cue | is_value | F.col("kind").isin("implied", "reserve")
    unit, none = _unit(F.col("kind")), Window.unboundedPreceding
    # the last lexeme that takes part, before this one
    prior = F.last(F.when(F.col("__part"), F.struct("kind", "start", "end", "__value")), ignorenulls=True).over(d.rowsBetween(none, -1))
    # whether the last cue or value before this one is a cue: a value that begins a list is then the first after its cue
    follows = F.last(F.when(is_cue | is_value, is_cue), ignorenulls=True).over(d.rowsBetween(none, -1))
    listed = is_value & F.col("__prior.__value") & F.col("gap").rlike(LISTED) & (_unit(F.col("__prior.kind")) == unit)
    away = F.col("start") - F.col("__prior.end")
    cue = F.when(is_cue, F.struct("kind", F.col("start").alias("at"), F.col("end").alias("to"), "after", "sentence", F.when(F.col("kind") == "exit", "x").otherwise("pct").alias("unit"), F.col("__prior.kind").alias("prior"), F.col("__prior.start").alias("prior_at"), away.alias("away"), F.coalesce((F.length("gap") == away) & F.col("gap").rlike(FILLERS), F.lit(False)).alias("led")))
    return [
        {"__part": part, "__value": is_value},
        {"__prior": prior, "__follows": follows},
        {"__listed": F.coalesce(listed, F.lit(False)), "__cue": cue},
        {
            "__next": F.lead(F.struct(F.col("__cue").alias("cue"), "gap", "sentence")).over(d), "__last": F.last("__cue", ignorenulls=True).over(d.rowsBetween(none, -1)),
            # of the value that begins this one's list
            "__first_list": F.last(F.when(is_value & ~F.col("__listed"), F.coalesce("__follows", F.lit(False))), ignorenulls=True).over(d.rowsBetween(none, 0)),
        },
    ]


def _valued(rows: DataFrame) -> DataFrame:
    """Marked lexemes with ``__c``, ``__field`` and ``__behind``: cue, field, and whether the cue comes after the value; null cue if one states no valuation.

    A value right before a cue of its unit belongs to it; else to the last such cue before it in its sentence, if no other
    value that is not part of the same list stands between. ``implied`` before the cue makes the field implied, if nothing but up to four filling words stands between.
    Each step is a column of its own: written into one another, the patterns would be sought anew for every use of the cue.
    """
    u = _unit(F.col("kind"))
    here = lambda c: F.col(f"{c}.sentence") == F.col("sentence")
    behind = F.coalesce(F.col("__value") & (F.col("__next.cue.unit") == u) & here("__next") & F.col("__next.gap").rlike(BEFORE_CUE), F.lit(False))
    ahead = (F.col("__last.unit") == u) & here("__last") & (F.col("start") - F.col("__last.to") <= CUE_REACH) & F.col("__first_list")
    rows = rows.withColumn("__behind", behind)
    rows = rows.withColumn("__c", F.when(F.col("__value"), F.when(F.col("__behind"), F.col("__next.cue")).when(ahead, F.col("__last"))))
    # a central bank's rate is no discount rate
    c = lambda f: F.col(f"__c.{f}")
    rows = rows.withColumn("__c", F.when(~((c("kind") == "discount") & c("prior").eqNullSafe("reserve") & (c("away") <= 30)), F.col("__c")))
    implied = (c("prior") == "implied") & c("led") & ~F.col("__behind")
    field = F.when(implied & (c("kind") == "growth"), "implied_growth").when(implied & (c("kind") == "exit"), "implied_multiple")
    for k, f in FIELD.items():
        field = field.when(c("kind") == k, f)
    return rows.withColumn("__field", field)


def stated(lexemes: DataFrame, *doc: str) -> DataFrame:
    """All lexemes with c, the cue of a value that states a rate, a growth rate or a multiple, its field, and whether they are reversed."""
    return _valued(_staged(lexemes, _marked(*doc))).withColumnsRenamed({"__c": "c", "__field": "field", "__behind": "reversed"})


def candidates(lexemes: DataFrame, *doc: str) -> DataFrame:
    """Rates, growth rates and multiples of each document: columns ``doc``, n, field, start, end, low, high, unit, raw ends, cue."""
    rows = stated(lexemes, *doc).where("c IS NOT NULL")
    return rows.select(
        *doc, "n", "field", F.least("start", "c.at").alias("start"), F.greatest("end", F.when(F.col("reversed"), F.col("c.to")).otherwise(F.col("end"))).alias("end"), "low", "high", _unit(F.col("kind")).alias("unit"), "raw_low", "raw_high",
        F.col("c.kind").alias("cue"), "reversed", F.col("start").alias("at"), "sentence",
    )


# Money in context: an amount carries the marks of its sentence, and what it is follows from their order. See ``MONEY_MARKS``.

#: Words that may stand between a mark and the amount that it speaks of, and between it and what makes it no offer.
NEAR_WORDS, CLAUSE_WORDS = 7, 14


def _head() -> Column:
    """What of a value's sentence stands before it."""
    return F.expr("right(`left`, greatest(start - sentence_start, 0))")


def _tail() -> Column:
    """What of a value's sentence stands behind it."""
    return F.expr("left(`right`, greatest(sentence_end - `end`, 0))")


def _named(*names: str):
    return lambda m: m["name"].isin(*names)


def _before(*names: str) -> Column:
    """Marks of these names before the amount, in order."""
    return F.filter("marks", lambda m: _named(*names)(m) & (m["to"] <= F.col("start")))


def _behind(*names: str) -> Column:
    """Marks of these names behind the amount and before what speaks of the next one: another amount, or the rest of the sum."""
    stop = F.array_min(F.transform(F.filter("marks", lambda m: _named("amount", "rest")(m) & (m["at"] >= F.col("end"))), lambda m: m["at"]))
    return F.filter("marks", lambda m: _named(*names)(m) & (m["at"] >= F.col("end")) & (m["at"] < F.coalesce(stop, F.lit(1 << 30))))


def _follows(marks: Column, first: str, second: str) -> Column:
    """Whether a mark ``first`` comes before a mark ``second``."""
    at = F.array_min(F.transform(F.filter(marks, _named(first)), lambda m: m["at"]))
    return F.coalesce(F.exists(marks, lambda m: _named(second)(m) & (m["at"] > at)), F.lit(False))


def _last(marks: Column) -> Column:
    return F.get(marks, F.size(marks) - 1)


def _words(begin: Column, end: Column) -> Column:
    """Number of words between two places before the amount, as far as its left side reaches."""
    side = F.substr("left", F.length("left") - (F.col("start") - begin) + 1, end - begin)
    return F.size(F.filter(F.split(side, r"\s+"), lambda w: w.rlike("[A-Za-z0-9]")))


def _per_share() -> Column:
    """Whether a dollar range is a value per share that an analysis gives: said in its sentence, of no market, in no cell of a table."""
    said = F.size(F.concat(_before("derived"), _behind("derived"))) > 0
    market = F.size(_before("market")) > 0
    paid = F.exists(_behind("cash"), lambda m: m["at"] <= F.col("end") + 5)
    cell = F.contains(F.concat(F.right(F.col("left"), F.lit(14)), F.substring("right", 1, 14)), F.lit("|"))
    shared = F.exists("marks", _named("share"))
    return (F.col("kind") == "usd_range") & (F.col("low") > 0) & (F.col("low") <= F.col("high")) & (F.col("high") <= 20000) & F.coalesce(said & shared & ~market & ~paid & ~cell, F.lit(False))


def _offered() -> Column:
    """Whether an amount is cash that holders receive: a word for it leads up to the amount, cash is near, no paper comes with it, and no
    word before it in its clause makes it another payment."""
    lead = _last(_before("receive", "amount"))
    leads = (lead["name"] == "receive") & (_words(lead["to"], F.col("start")) <= NEAR_WORDS)
    near = F.exists(_behind("cash"), lambda m: F.size(F.filter(F.split(F.substr("right", F.lit(1), m["at"] - F.col("end")), r"\s+"), lambda w: w.rlike("[A-Za-z0-9]"))) <= NEAR_WORDS)
    cash = near | F.exists(_before("cash"), lambda m: m["at"] >= lead["at"])
    other = F.exists(_before("unlike", "market"), lambda m: (m["to"] <= lead["at"]) & (_words(m["to"], lead["at"]) <= CLAUSE_WORDS))
    # "and", then a number of shares, right behind the cash
    mixed = F.exists(_behind("plus"), lambda p: F.exists("marks", lambda m: _named("paper")(m) & (m["at"] >= p["to"]) & (m["at"] <= p["to"] + 8)))
    return (F.col("kind") == "usd") & F.col("low").between(0.5, 5000) & F.coalesce(leads & cash & ~other & ~mixed, F.lit(False))


def _fees(*doc: str) -> Stages:
    """``fees``, the fields that an amount states: total, opinion and contingent part of an advisor's fee.

    A sentence counts if it has a word for fees and none for other payments, and a house in it or shortly before. An amount is
    introduced if the last word before it that bears on pay is one for fees. What it is for stands behind it, before the next amount: an
    opinion that is given, or a closing that it depends on; or between the amounts before it, as in ``an opinion fee of``. The first amount that
    is introduced is the total; it is the opinion's fee too where that is what it is for, unless it is credited. A total that is followed by
    ``of which`` has no part of its own.
    """
    d, _, sentence = _windows(*doc)
    has = lambda k: F.max((F.col("kind") == k).cast("int")).over(sentence) == 1
    inside = F.last(F.when(F.col("kind") == "house", F.col("name")), ignorenulls=True).over(sentence)
    before = F.when(F.col("__house.start") >= F.col("sentence_start") - 250, F.col("__house.name"))
    house = F.coalesce(before, F.col("__inside"))
    scaled = F.col("raw_low").rlike("(?i)thousand|million|billion")
    ranged = F.col("left").rlike(r"(?i)between\s*$") | F.col("right").rlike(r"(?i)^\s+and\s+\$")
    # whether the sentence counts is the same for all amounts of it, so which is the first does not hang on it
    counts = F.col("__has_fee") & ~F.col("__has_other") & house.isNotNull()
    amount = (F.col("kind") == "usd") & (scaled | (F.col("low") <= 100e6)) & ~ranged
    introduced = F.coalesce(_last(_before("fee_word", "earlier", "credit", "part", "amount", "percent"))["name"] == "fee_word", F.lit(False))
    own, parts = _behind("given", "opinion", "depends", "closing", "part"), ["opinion", "depends", "more", "fee_word", "amount"]
    # the words right before this amount's own word for a fee: "opinion fee", "contingent fee", "additional fee"
    lead = _before(*parts)
    titled = lambda *names: F.coalesce((_last(lead)["name"] == "fee_word") & F.get(lead, F.size(lead) - 2)["name"].isin(*names), F.lit(False))
    opinion = titled("opinion") | _follows(own, "given", "opinion")
    contingent = titled("depends") | _follows(own, "depends", "closing") | (introduced & F.coalesce(F.get(own, F.lit(0))["name"] == "closing", F.lit(False)))
    kind = F.when(opinion, "fee_opinion").when(contingent, "fee_contingent")
    which = F.coalesce(F.get(own, F.lit(0))["name"] == "part", F.lit(False)) | F.coalesce(F.col("right").rlike(r"(?i)^\W*of\s+which\b"), F.lit(False))
    credited = F.exists("marks", _named("credit"))
    # as if no total came before
    alone = F.when(~which, kind)
    total = introduced & ~titled("more") & ~(credited & alone.eqNullSafe("fee_opinion"))
    fee = F.when(amount & counts, F.struct(kind.alias("kind"), alone.alias("alone")))
    first = F.min(F.when(amount & total, F.col("n"))).over(sentence)
    at_first, behind = F.col("n") == F.col("__first"), F.coalesce(F.col("n") > F.col("__first"), F.lit(False))
    part = F.when(behind, F.col("__fee.kind")).otherwise(F.col("__fee.alone"))
    both = F.when(at_first, F.array(F.lit("fee_total"), F.when(F.col("__fee.alone") == "fee_opinion", F.lit("fee_opinion")))).otherwise(F.array(part))
    return [
        {},
        {"__house": _last_house(d)},
        {},
        {"__has_fee": has("fee"), "__has_other": has("fee_other"), "__inside": inside, "__first": first},
        {"fee_house": house, "__fee": fee},
        {"fees": F.when(F.col("__fee").isNotNull(), F.array_compact(both))},
    ]


def money_terms(lexemes: DataFrame, *doc: str) -> DataFrame:
    """Dollar values: per-share ranges, fees (total, opinion, contingent) with their house; columns as ``candidates`` and house."""
    rows = _staged(lexemes, _fees(*doc))
    fields = F.coalesce(F.when(_per_share(), F.array(F.lit("value_per_share"))), F.col("fees"))
    out = rows.withColumn("field", F.explode(fields))
    usd = F.col("field") == "value_per_share"
    scale = F.when(usd, 1.0).otherwise(1e6)
    return out.select(*doc, "n", "field", "start", "end", (F.col("low") / scale).alias("low"), (F.col("high") / scale).alias("high"), F.when(usd, "usd").otherwise("usd_million").alias("unit"), "raw_low", "raw_high", F.lit("money").alias("cue"), F.lit(False).alias("reversed"), F.col("start").alias("at"), "sentence", F.when(~usd, F.col("fee_house")).alias("house"))


def offer_price(lexemes: DataFrame, *doc: str) -> DataFrame:
    """(doc, low, votes, start): the price most often stated as cash consideration; two votes at least, ties to the earliest."""
    votes = lexemes.where(_offered()).groupBy(*doc, "low").agg(F.count("*").alias("votes"), F.min("start").alias("start"))
    best = votes.groupBy(*doc).agg(F.max(F.struct("votes", (-F.col("start")).alias("s"), "low", "start")).alias("b"))
    return best.select(*doc, "b.low", "b.votes", "b.start").where("votes >= 2")


# Context: sections, houses, analyses and parties around a value.


def _contexts(*doc: str) -> Stages:
    """The section that a lexeme is in and the last house, analysis and party before it, parties of its sentence, houses of opinions."""
    d, s, sentence = _windows(*doc)
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    before, here = d.rowsBetween(first, -1), d.rowsBetween(first, 0)
    kind = F.col("kind")
    mark = lambda test: F.last(F.when(test, F.struct("start", "name")), ignorenulls=True).over(before)
    party = F.when(kind.isin("filer", "counter"), F.struct("kind", "start", "sentence"))
    whole = d.rowsBetween(first, last)
    analysis, strong = kind == "analysis", F.col("raw_low").eqNullSafe("strong")
    near = (kind == "house") & (F.col("start") >= F.col("__seg")) & (F.col("start") < F.col("__seg") + REACH) & (F.col("__section.kind") == "opinion")
    return [
        {},
        {
            "__section": F.last(F.when(F.col("__heading").isNotNull(), F.struct(F.col("__heading").alias("kind"), F.col("start"), F.col("end"))), ignorenulls=True).over(here),
            "__house": _last_house(d), "__actor": mark((kind == "house") & F.col("raw_low").eqNullSafe("acts")),
            "__strong": mark(analysis & strong), "__weak": mark(analysis & ~strong & (F.col("name") != "other")), "__mark": mark(analysis & (F.col("name") != "other")),
            "__party": F.last(party, ignorenulls=True).over(before),
            # lines that soon speak of a combined company
            "__joint_lines": F.collect_set(F.when((kind == "pro_forma") & (F.col("start") - F.col("line") < PARAGRAPH), F.col("line"))).over(whole),
        },
        {"__seg": F.coalesce("__section.start", F.lit(0))},
        {
            "__right": F.first(party, ignorenulls=True).over(s.rowsBetween(1, last)), "__joint": F.max((kind == "pro_forma").cast("int")).over(sentence) == 1,
            # of all opinions of the document, in its order: bounded by their number, since none is looked into further than ``REACH``
            "__houses": F.collect_list(F.when(near, F.struct("start", "name", F.col("__seg").alias("seg")))).over(whole),
        },
    ]


def _placed(rows: DataFrame, role: Column) -> DataFrame:
    """Values with region, advisor, analysis and subject; ``start`` is where the fact's span begins, ``at`` the value."""
    at, seg = F.col("at"), F.col("__section")
    kind = F.when(seg["kind"].isin("opinion", "background"), seg["kind"]).otherwise("other")
    local = F.coalesce((F.col("__house.start") >= at - HOUSE_REACH) & (F.col("__mark.start") >= at - MARK_REACH), F.lit(False))
    needs = F.col("field").isin(*VALUATION, "value_per_share")
    rows = rows.withColumn("region", F.when(kind != "other", kind).when(local & needs, "context").otherwise("other"))
    own = F.col("region") != "context"
    # a value that only its surroundings place has no section to look back into
    floor = lambda reach: F.when(own, F.greatest(F.coalesce(seg["start"], F.lit(0)), at - reach)).otherwise(at)
    actor = F.when(F.col("__actor.start") >= floor(HOUSE_REACH), F.col("__actor.name"))
    section = F.when(own & (seg["kind"] == "opinion"), majority(F.filter("__houses", lambda h: h["seg"] == F.col("__seg")), seg["end"]))
    named = lambda c: F.when(F.col(f"{c}.start") >= floor(ANALYSIS_REACH), F.col(f"{c}.name"))
    away = lambda c: F.abs(F.col(f"{c}.start") - at)
    within = lambda c: F.when(away(c) <= SENTENCE_REACH, F.col(f"{c}.kind"))
    # the last party before the value, if it is of the same sentence
    left = F.when(F.col("__party.sentence") == F.col("sentence"), within("__party"))
    nearest = F.when(within("__right").isNull() | (left.isNotNull() & (away("__party") <= away("__right"))), left).otherwise(within("__right"))
    earlier = F.when(F.col("__party.start") >= F.when(own, floor(SUBJECT_REACH)).otherwise(at - SUBJECT_REACH), F.col("__party.kind"))
    side = F.coalesce(nearest, earlier)
    filer = F.when(role == "acquirer", "acquirer").otherwise("target")
    counter = F.when(role == "acquirer", "target").otherwise("acquirer")
    joint = F.col("__joint") | F.array_contains("__joint_lines", F.col("line")) | F.coalesce(F.col("name") == "pro_forma", F.lit(False))
    return rows.withColumns({
        "advisor": F.coalesce("house", actor, section, F.lit("unattributed")), "analysis": F.coalesce(named("__strong"), named("__weak"), F.lit("unspecified")),
        "subject": F.when(joint, "pro_forma").when(side == "filer", filer).when(side == "counter", counter).otherwise("unspecified"),
    })


def judged(found: DataFrame) -> DataFrame:
    """Adds ``reason``, the first check that a candidate fails, or null: a fact. Rejected candidates are kept."""
    field, needs = F.col("field"), F.col("field").isin(*VALUATION, "value_per_share")
    point = (F.col("low") == F.col("high")) & (F.col("raw_low") == F.col("raw_high"))
    reason = F.coalesce(
        E.bounds_problem(field, F.col("low"), F.col("high")),
        F.when(field.isin(VALUATION) & point & F.col("after").rlike(CELL), "table_row"),
        F.when(needs & (F.col("region") == "other"), "outside_analysis_context"),
        F.when(field.isin(VALUATION) & (F.col("analysis") == "unspecified"), "no_analysis_marker"),
        F.when((field == "value_per_share") & ~F.col("analysis").isin(DCF_LIKE), "not_dcf_analysis"),
        F.when(F.size("problems") > 0, F.concat(F.lit("provenance:"), F.get("problems", F.lit(0)))),
    )
    return found.withColumn("reason", reason)


def accepted(found: DataFrame) -> DataFrame:
    """The facts among judged values: those without a reason.

    The reason goes through an explosion, since Spark moves a filter no further: it would put all that reasons are made of into the
    filter and work it out again for each value.
    """
    return found.withColumn("__reason", F.explode_outer(F.array("reason"))).where("__reason IS NULL").drop("__reason")


def verify(facts: DataFrame, span: Column, snippet: Column | None = None) -> DataFrame:
    """Adds ``problems``: what keeps a fact's span, as the extraction cut it, from proving it.

    The span must not be empty and must hold both ends of the value as they are written; numbers read anew from those ends must be the
    values; a snippet must hold the span and be no longer than ``SNIPPET``. A stored table is checked against its texts, with
    spans cut anew and read again, by ``verification.verify_release``.
    """
    low, high, scale = E.parse_number(F.col("raw_low")), E.parse_number(F.col("raw_high")), F.when(F.col("unit") == "usd_million", 1e6).otherwise(1.0)
    close = lambda a, b: F.abs(a / scale - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    tests = [
        F.when(F.col("start") < 0, F.lit("span_out_of_range")).when(F.col("start") >= F.col("end"), F.lit("span_out_of_range")),
        F.when(~(F.contains(span, F.col("raw_low")) & F.contains(span, F.col("raw_high"))), F.lit("value_text_not_in_span")),
        F.when(~(F.coalesce(close(low, F.col("low")), F.lit(False)) & F.coalesce(close(high, F.col("high")), F.lit(False))), F.lit("value_not_reproduced_from_span")),
    ]
    if snippet is not None:
        tests += [F.when(~F.contains(snippet, E.collapse(span)), F.lit("snippet_does_not_contain_span")), F.when(F.length(snippet) > E.SNIPPET, F.lit("snippet_too_long"))]
    # not compacted, as Spark compiles no filter of an array, nor what it is made of
    return facts.withColumn("problems", F.array_except(F.array(*tests), F.array(F.lit(None).cast("string"))))


def extract(docs: DataFrame, *doc: str, text: str = "text", lines: str | None = None, company: str | None = None, prefilter: bool = True) -> DataFrame:
    """All judged values of documents: facts where ``reason`` is null, and rejected candidates with their reason.

    Columns ``doc``, n, field, start, end, low, high, unit, raw ends, advisor, subject, analysis, region, metric, valuation_date,
    snippet with its bounds, problems, reason and doc_sha256. ``lines`` gives headings and so sections; ``company`` the filer's name, from which its
    aliases, its role and the other companies follow. One pass over each text and one shuffle on ``doc``; documents are bounded,
    however many there are. Null and empty texts have no values; repeated documents must differ in ``doc``.
    """
    whole = F.col(text).cast("string")
    # dealt here, so that the names of a text's companies are found in all tasks too
    docs = dealt(docs, *doc).withColumn("doc_sha256", E.fingerprint(whole))
    if company:
        docs = docs.withColumn("__filer", P.aliases(F.col(company)))
        docs = docs.withColumns({"__other": P.other_names(whole, F.col("__filer")), "__role": P.filer_role(whole, F.col("__filer"))})
    else:
        docs = docs.withColumn("__role", F.lit("target"))
    keep = [*doc, "doc_sha256", "__role"]
    lex = lexemes(docs, text, *keep, prefilter=prefilter, lines=lines, filer="__filer" if company else None, other="__other" if company else None, by=doc, thin=True)
    lex = with_heading_kind(lex, "__heading", F.when(F.col("kind") == "line", F.col("name")), F.col("low"))
    every = _windows(*doc)[0].rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offers = F.collect_list(F.when(F.col("__offered"), F.struct("low", "start"))).over(every)
    rows = _valued(_staged(lex, _marked(*doc), _fees(*doc), _contexts(*doc), [{"__offered": _offered()}, {}, {}, {"__offers": offers}]))
    # a lexeme's fields differ, as only amounts have several
    rows = rows.withColumn("__per_share", F.col("__c").isNull() & _per_share())
    fields = F.when(F.col("__c").isNotNull(), F.array("__field")).when(F.col("__per_share"), F.array(F.lit("value_per_share"))).otherwise(F.coalesce("fees", F.array().cast("array<string>")))
    rows = rows.withColumn("__fields", F.concat(fields, F.when(F.col("__offered"), F.array(F.lit("offer_price"))).otherwise(F.array().cast("array<string>"))))
    # a filter behind the explosion, since one before it would compute all fields twice
    rows = rows.withColumn("field", F.explode_outer("__fields")).where("field IS NOT NULL")
    # the price with most votes, ties to the earliest; only its first statement is a fact
    is_offer = F.col("field") == "offer_price"
    said = lambda low: F.filter("__offers", lambda o: o["low"] == low)
    first = F.array_min(F.transform(said(F.col("low")), lambda o: o["start"]))
    ranks = F.transform(F.array_distinct(F.transform("__offers", lambda o: o["low"])), lambda low: F.struct(F.size(said(low)), -F.array_min(F.transform(said(low), lambda o: o["start"])), low.alias("low")))
    best = F.when((F.size(said(F.col("low"))) >= 2) & (F.col("start") == first), F.array_max(ranks)["low"] == F.col("low"))
    rows = rows.where(~is_offer | best)
    valued, money = F.col("field").isin(VALUATION), F.col("field").startswith("fee_")
    forward = F.when(F.col("field").startswith("implied"), F.col("__c.prior_at")).otherwise(F.col("__c.at"))
    begin = F.when(valued, F.least("start", F.when(F.col("__behind"), F.col("start")).otherwise(forward))).otherwise(F.col("start"))
    stop = F.when(valued & F.col("__behind"), F.greatest("end", "__c.to")).otherwise(F.col("end"))
    scale = F.when(money, 1e6).otherwise(1.0)
    rows = rows.withColumns({
        "at": F.col("start"), "to": F.col("end"), "house": F.when(money, F.col("fee_house")), "begin": begin, "stop": stop, "unit": F.when(money, "usd_million").when(valued, _unit(F.col("kind"))).otherwise("usd"),
        "low": F.col("low") / scale, "high": F.col("high") / scale, "after": F.when(F.col("__behind") & valued, F.col("__c.after")).otherwise(F.col("after")), "head": _head(), "tail": _tail(),
    })
    rows = _placed(rows, F.col("__role")).withColumn("__said", F.concat("head", "written", "tail"))
    # pieces of the text around the value: before the span, the span, behind it
    middle = F.concat(F.right("head", F.col("at") - F.col("begin")), "written", F.left("tail", F.col("stop") - F.col("to")))
    rows = rows.withColumn("span", middle).withColumn("__h", F.substr("head", F.lit(1), F.length("head") - (F.col("at") - F.col("begin")))).withColumn("__t", F.substr("tail", F.col("stop") - F.col("to") + 1))
    room = F.greatest(F.lit(E.SNIPPET) - F.length("span"), F.lit(0))
    n_left = F.least(F.length("__h"), F.greatest(F.floor(room / 2), room - F.length("__t"))).cast("int")
    n_right = F.least(F.length("__t"), room - n_left).cast("int")
    rows = rows.withColumns({"snippet": E.collapse(F.concat(F.right("__h", n_left), "span", F.left("__t", n_right))), "snippet_start": F.col("begin") - n_left, "snippet_end": F.col("stop") + n_right})
    around = F.concat(F.right("left", F.lit(E.METRIC_BEFORE) + F.col("at") - F.col("begin")), "written", F.left("right", F.lit(E.METRIC_AFTER) + F.col("stop") - F.col("to")))
    rows = rows.withColumns({
        "metric": E.metric_of(around, F.col("unit")),
        "valuation_date": F.when(F.col("field") == "discount_rate", E.valuation_date(F.col("__said"), F.length("head") - (F.col("at") - F.col("begin")))).otherwise(""),
        "start": F.col("begin"), "end": F.col("stop"), "analysis": F.when(valued | (F.col("field") == "value_per_share"), F.col("analysis")).otherwise(""), "subject": F.when(valued | (F.col("field") == "value_per_share"), F.col("subject")).otherwise(""),
        "advisor": F.when(is_offer, "unattributed").otherwise(F.col("advisor")),
    })
    out = judged(verify(rows, F.col("span"), F.col("snippet")))
    return out.select(*doc, "n", "field", "start", "end", "low", "high", "unit", "raw_low", "raw_high", "advisor", "subject", "analysis", "region", "metric", "valuation_date", "snippet", "snippet_start", "snippet_end", "problems", "reason", "doc_sha256", "sentence")

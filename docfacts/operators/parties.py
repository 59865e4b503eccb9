"""Names of the parties of a filing, natively: a filer's aliases, its role, and the other companies that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms at the end of names, words too general to stand for a company, words that are no company's name.
LEGAL = ["ag", "co", "company", "corp", "corporation", "de", "inc", "incorporated", "limited", "llc", "lllp", "lp", "ltd", "nv", "plc", "sa", "se", "the", "trust"]
GENERAL = ["american", "first", "united", "national", "general", "global", "international", "new", "the", "bank", "financial"]
NO_NAMES = [
    "Acquirer", "Acquiror", "Any", "Buyer", "Class", "Common", "Company", "Each", "For", "Holders", "In", "Merger", "New", "No", "Of", "Our", "Parent", "Preferred", "Purchaser", "Series", "Sub", "Such", "Surviving", "The", "Treasury",
]
#: What stands behind a company's name where its shares are spoken of.
SHARES = ["common shares", "common stock", "ordinary shares", "shareholders", "shares", "stockholders"]
#: Aliases that evidence of a role is sought for, companies returned at most, mentions that each needs, words of a name.
ROLE_ALIASES, MOST, MENTIONS, LONGEST = 3, 2, 6, 4


def aliases(company: Column) -> Column:
    """Names that a filing may use for a company, longest first: without legal forms, then without one last word after another.

    A single word stands alone only if it has three letters and is not general; a long one in capitals is also found in
    mixed case, so it is given so. Null: an empty array.
    """
    words = F.filter(F.split(F.regexp_replace(company, "[,\\s]+", " "), " "), lambda w: w != "")
    bare = lambda w: F.lower(F.replace(w, F.lit("."), F.lit("")))
    # the name ends with its last word that is no legal form
    size = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(~bare(w).isin(LEGAL), i + 1))), F.lit(0))
    first = F.get(words, F.lit(0))
    alone = F.when((F.length(first) > 4) & (F.upper(first) == first) & first.rlike("[A-Z]"), F.initcap(first)).otherwise(first)
    fits = (size >= 1) & (F.length(first) >= 3) & ~F.lower(first).isin(GENERAL)
    longer = F.when(size >= 2, F.transform(F.sequence(size, F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " ")))
    return F.concat(F.coalesce(longer, F.array().cast("array<string>")), F.when(fits, F.array(alone)).otherwise(F.array().cast("array<string>")))


def _any_of(names: Column) -> Column:
    return F.concat(F.lit(r"(?:\Q"), F.array_join(names, r"\E|\Q"), F.lit(r"\E)"))


def filer_role(text: Column, names: Column) -> Column:
    """``acquirer`` if a text says more often that the filer's shares are issued than that they are turned into something else, else ``target``.

    The whole text counts, sentence by sentence. Without a text or names the role is ``target``.
    """
    few = F.slice(names, 1, ROLE_ALIASES)
    own, firsts = _any_of(few), F.concat(F.lit(r"\Q"), F.array_join(F.transform(few, lambda n: F.left(n, F.lit(1))), ""), F.lit(r"\E"))
    # a name whose first character was read
    read = F.concat(F.lit("(?:"), F.array_join(F.transform(few, lambda n: F.concat(F.lit(r"(?<=\Q"), F.left(n, F.lit(1)), F.lit(r"\E)\Q"), F.substring(n, 2, 1 << 30), F.lit(r"\E"))), "|"), F.lit(")"))
    # each pattern begins with a set of characters, as Java tries a whole pattern at every place of a text otherwise
    issued = F.concat(F.lit("(?i)[i"), firsts, F.lit(r"](?:(?<=\bi)ssu(?:ance|ing|e)\b[^.;]{0,60}?\bshares\s+of\s+(?:the\s+)?"), own, F.lit(r"|"), read, F.lit(r"[^.;]{0,20}?\bissuance\s+proposal)"))
    turned = F.concat(F.lit(r"(?i)[e](?<=\be)(?:ach|very)\b[^.;]{0,20}?\bshare\s+of\s+(?:the\s+)?"), own, F.lit(r"[^.]{0,300}?\b(?:converted|entitled|right)\b"))
    # a pattern is only sought in texts that hold a word of it, and what is turned only where something is issued
    holds = lambda word: F.contains(F.lower(text), F.lit(word))
    n_turned = F.when(holds("each") | holds("every"), F.regexp_count(text, turned)).otherwise(0)
    more = holds("issu") & (F.regexp_count(text, issued) > n_turned)
    return F.when((F.size(names) > 0) & more, "acquirer").otherwise("target")


def _spoken_of(text: Column, names: Column) -> Column:
    """Structs (mentions, place of the first, name) of companies whose shares a text speaks of, the filer's own names left out."""
    name, shares = r"[A-Z][\w&'-]*(?:\.[\w&'-]+)*\.?\s+", rf"(?:[A-Z]\s+)?(?i:{'|'.join(s.replace(' ', '[ ]+') for s in SHARES)})\b"
    # sought without a group at its beginning, which Java would open at every place of a text
    found = F.regexp_extract_all(text, F.lit(rf"{name}(?:{name}){{0,{LONGEST - 1}}}{shares}"), F.lit(0))
    run = lambda m: F.regexp_extract(m, rf"^((?:{name}){{1,{LONGEST}}}){shares}", 1)
    named = F.transform(found, lambda m: F.array_join(F.filter(F.split(F.trim(F.regexp_replace(run(m), "['’]s\\b", "")), r"\s+"), lambda w: ~w.isin(NO_NAMES)), " "))
    other = F.filter(named, lambda n: (n != "") & ~F.exists(names, lambda a: F.startswith(n, a) | F.startswith(a, n)))
    counted = lambda all_: F.transform(F.array_distinct(all_), lambda n: F.struct(F.size(F.filter(all_, lambda x: x == n)).cast("long").alias("mentions"), (-F.array_position(all_, n)).alias("place"), n.alias("name")))
    # bound as the one element of an array: written twice within a lambda, the text would be searched anew for each name
    return F.get(F.transform(F.array(other), counted), F.lit(0))


def _foremost(text: Column, names: Column) -> Column:
    top = F.slice(F.sort_array(_spoken_of(text, names), asc=False), 1, MOST)
    return F.filter(F.coalesce(top, F.array().cast("array<struct<mentions:bigint,place:bigint,name:string>>")), lambda c: c["mentions"] >= MENTIONS)


def other_names(text: Column, names: Column) -> Column:
    """The companies besides the filer that a text names most before words for shares: those of ``MOST`` with ``MENTIONS`` or more."""
    return F.transform(_foremost(text, names), lambda c: c["name"])


def other_companies(docs: DataFrame, text: str, names: str, *doc: str) -> DataFrame:
    """(doc, name, mentions) of ``other_names`` of each document; ties go to the name that comes first."""
    return docs.select(*doc, F.explode(_foremost(F.col(text), F.col(names))).alias("c")).select(*doc, "c.name", "c.mentions")

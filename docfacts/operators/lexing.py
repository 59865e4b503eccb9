"""One scan of a text into lexemes: values, cues, houses, parties, analyses and headings' lines, each with its place.

The scan is a small per-row helper in one Arrow UDF. It decides nothing about meaning: what value belongs to what
cue, house or analysis is found by windows over the lexemes of a document, see ``extraction``. A value also carries the text
on both sides of it, so that no later step reads the document again.

Each kind of lexeme says what words it can begin with, so that a place in a text is only tried if it begins such a word, and then only
against kinds that can begin there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import ACTS, ANALYSES, CUES, FEE_WORDS, MONEY_MARKS, PARTIES, PUBLICATIONS, houses

DASHES = "-‐‑‒–—―−"
NUMBER = r"\d{1,3}(?:\.\d+)?"
SIGNED = rf"(?:(?:negative|minus)\s+)?\(?[{DASHES}]?{NUMBER}\)?"
TO = rf"(?:\s+(?:to|through|and)\s+|\s*[{DASHES}]\s*)"
PERCENT, TIMES = r"(?:\s*%\)?|\s*per\s?cent\b)", r"(?:\s*x\b|\s*×|\s*times\b)"
FREE = r"(?<![\w.,$])"
AMOUNT = r"\$\s?\d{1,4}(?:,\d{3})*(?:\.\d+)?"
SHARE = r"\s+per\s+(?:\w+\s+){0,2}(?:share|unit)"
FROM_TO = rf"\s*{NUMBER}{TIMES}?{TO}{NUMBER}{TIMES}"
SIGNS, WORDED = list("0123456789(" + DASHES), ["negative", "minus"]


def phrases(forms: list[str]) -> str:
    """A pattern for any of the phrases, longest first. Blanks are any white space or hyphen; ``(s)`` is an ending that may lack."""
    def one(p: str) -> str:
        body = r"[\s-]+".join(re.escape(w).replace(r"\(s\)", "s?").replace(r"\(ies\)", "(?:y|ies)") for w in p.split())
        return (r"\b" if p[0].isalnum() else "") + body + (r"\b" if p[-1].isalnum() or p[-1] == ")" else "")

    return "|".join(sorted(map(one, forms), key=len, reverse=True))


def spanning(opens: list[str], most: int, closes: list[str]) -> str:
    """One of ``opens``, up to ``most`` words, one of ``closes``."""
    return rf"(?:{phrases(opens)})(?:[\s-]+[a-z][a-z/&-]*){{0,{most}}}?[\s-]+(?:{phrases(closes)})"


def _heads(forms: list[str]) -> list[str]:
    """First words of phrases, as far as they are always written."""
    return sorted({re.escape(f.split()[0].split("(")[0]) for f in forms})


FORMS = houses()
#: Kinds that see upper and lower case; others do not.
EXACT = {"house", "counter", "filer"}
#: (kind, what it can begin with: patterns of first words, or single signs, pattern).
RULES: list[tuple[str, list[str] | str, str]] = [
    ("house", _heads(list(FORMS)), rf"(?:{phrases(list(FORMS))})(?!\s+(?:{phrases(PUBLICATIONS)}))"),
    ("pct_range", SIGNS + WORDED, rf"{FREE}(?P<low_pct>{SIGNED}{PERCENT}?){TO}(?P<high_pct>{SIGNED}{PERCENT})"),
    ("pct", SIGNS + WORDED, rf"{FREE}{SIGNED}{PERCENT}"),
    ("x_range", SIGNS[:10], rf"{FREE}(?P<low_x>{NUMBER}{TIMES}?){TO}(?P<high_x>{NUMBER}{TIMES})"),
    ("x", SIGNS[:10], rf"{FREE}{NUMBER}{TIMES}"),
    ("usd_range", ["$"], rf"(?<![\w.])(?P<low_usd>{AMOUNT})(?:{SHARE})?{TO}(?P<high_usd>\$?\s?\d{{1,4}}(?:,\d{{3}})*(?:\.\d+)?)(?![\d,]*\d?%)(?!\s*(?:thousand|million|billion)\b)"),
    ("usd", ["$"], rf"(?<![\w.]){AMOUNT}(?:\s*(?:thousand|million|billion)\b)?"),
    ("discount", _heads(CUES["discount"]), phrases(CUES["discount"])),
    ("growth", _heads(CUES["growth opens"] + CUES["growth"]), rf"{spanning(CUES['growth opens'], 4, CUES['growth closes'])}|{phrases(CUES['growth'])}"),
    ("exit", _heads(CUES["exit opens"] + ["terminal"] + CUES["multiple leads"] + CUES["told again"]), rf"{spanning(CUES['exit opens'], 8, CUES['exit closes'])}|terminal\s+(?:values?|year)(?=[^.;]{{0,120}}\b(?:{phrases(CUES['worked out'])}))"
     rf"|(?:{phrases(CUES['multiple leads'])})(?={FROM_TO}[^.;]{{0,220}}?\bterminal\s+values?)|(?:{phrases(CUES['told again'])})(?={FROM_TO}\s+referred\s+to\s+above)"),
    ("implied", ["impl"], r"\bimpl(?:ied|ying|ies|y)\b"),
    ("reserve", _heads(CUES["reserve"]), phrases(CUES["reserve"])),
    ("fee_other", _heads(FEE_WORDS["other"]), phrases(FEE_WORDS["other"])),
    ("fee", _heads(FEE_WORDS["fee"]), phrases(FEE_WORDS["fee"])),
    *((f"analysis_{name}", _heads(forms), phrases(forms)) for name, forms in ANALYSES.items()),
    ("analysis_chosen", ["selected"], spanning(["selected"], 3, ["company", "companies"])),
    ("pro_forma", _heads(PARTIES["pro forma"]), phrases(PARTIES["pro forma"])),
    ("counter", _heads(PARTIES["counter"]), phrases(PARTIES["counter"])),
    ("filer", [r"[Tt]he\s+Company", "Company"], r"(?:[Tt]he\s+)?Company\b"),
]
#: What else a letter is to a pattern that does not see case.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
#: What ends a sentence: a line's end, or a sign before white space and what can open a sentence, but not after short forms. One set of
#: signs comes first, here and in other patterns that are sought in whole texts: Python finds those of a set much sooner than those of alternatives.
SHORT_FORMS = "".join(rf"(?<!{f}\.)" for f in (r"\b[A-Z]", "Inc", "Co", "Corp", "Ltd", "No"))
STOP = re.compile(rf"[.;!?\n](?:(?<=\n)|{SHORT_FORMS}\s+(?=[A-Z\"'(\[$]))")
SCALE = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
#: A text that states a value of any field holds one of these.
ANCHORS = r"(?i)discount|\bWACC\b|average[\s-]+cost|costs?\s+of\s+(?:equity|capital)|growth|perpetuity\s+rate|multiple|ratio|terminal\s+(?:value|year)|\$\s?\d"
AND = re.compile(r"\sand\s", re.I)
#: Most text between two lexemes that is kept for the next step, behind a lexeme to tell cells of a table, and around a value.
GAP, AFTER, AROUND = 80, 14, 600
#: A mark of an analysis is strong in a line of so many characters, or so near to the line's start; headings are no longer.
SHORT_LINE, LINE_START, HEADING, ABOVE = 160, 40, 260, 140
NEXT_ACT = re.compile(r"[^.]{0,80}?\b(?:" + "|".join(ACTS) + ")", re.I)
PRO_FORMA = re.compile(f"(?i:{phrases(PARTIES['pro forma'])})")


def _opening(rests: set[tuple[str, bool]]) -> str:
    """A pattern for any of the ends of words, each with whether its case counts: by their first letters, which Python rules out at once."""
    by: dict[str, list[str]] = {}
    for rest, exact in sorted(rests):
        ch = rest[:1]
        first = "" if not (ch.isascii() and ch.isalpha()) else ch if exact else f"{ch.lower()}{ch.upper()}{FOLDED.get(ch.lower(), '')}"
        end = rest[1:] if first else rest
        by.setdefault(first, []).append(end if exact else f"(?i:{end})")
    return "|".join(f"[{first}](?:{'|'.join(ends)})" if first else "|".join(ends) for first, ends in by.items())


def _dispatch() -> tuple[dict[str, re.Pattern], re.Pattern]:
    """(first character -> pattern of the lexemes that it can begin, pattern of a sign other than a letter or digit and a word that can begin one)."""
    by: dict[str, list[str]] = {}
    words: dict[str, set[tuple[str, bool]]] = {}
    for kind, heads, pattern in RULES:
        exact = kind in EXACT
        own: dict[str, set[tuple[str, bool]]] = {}
        for h in heads:
            first, rest = ("Tt", h[4:]) if h.startswith("[Tt]") else (h[0], h[1:])
            for ch in first if exact else {first.lower(), first.upper()}:
                own.setdefault(ch, set()).add((rest, exact))
        for ch, rests in own.items():
            by.setdefault(ch, []).append(f"(?P<{kind}>{pattern})" if exact else f"(?i:(?P<{kind}>{pattern}))")
            if ch.isalpha():
                words.setdefault(ch, set()).update(rests)
    of = lambda test: "|".join(f"[{ch}](?:{_opening(rests)})" for ch, rests in sorted(words.items()) if test(ch))
    begin = f"[0-9]|(?=[a-z])(?:{of(str.islower)})|(?=[A-Z])(?:{of(str.isupper)})"
    return {ch: re.compile("|".join(own)) for ch, own in by.items()}, re.compile(f"[^A-Za-z0-9](?={begin})")


#: Form of a mark in lower case with single blanks -> what it does; some forms do several things.
MARK_KINDS: dict[str, list[str]] = {}
for _kind, _forms in (MONEY_MARKS | {"fee_word": FEE_WORDS["fee"]}).items():
    for _form in {f.replace("(s)", end) for f in _forms for end in ("", "s")}:
        MARK_KINDS.setdefault(_form, []).append(_kind)
#: What is no plain form, with what it begins with: amounts, percent signs, a value per something, per share or unit, and a number of shares or units.
MARK_SIGN = [("$", r"(?P<amount>\$\s?\d)"), ("%", r"(?P<percent>%)")]
MARK_SPANS = [
    ("v", r"(?P<value>\bvalues?(?=\s+per\b))"), ("p", r"(?P<share>\bper\s+(?:[\w&.'-]+\s+){0,4}?(?:share|unit)s?\b)"),
    ("0123456789oha", r"(?P<paper>(?<![\d.,$])\b(?:\d[\d,.]*|one|half|all|a\s+fraction|a\s+portion)\s+(?:(?!per\b)[a-z]+\s+){0,5}?(?:shares?|stock|units?)\b)"),
]


def _mark_pattern(first: str | None = None) -> re.Pattern:
    """A pattern for marks, or for those that begin with ``first``."""
    forms = [f for f in MARK_KINDS if first is None or f[0] == first]
    of = lambda rules: [p for begin, p in rules if first is None or first in begin]
    return re.compile("|".join([*of(MARK_SIGN), *([f"(?P<word>{phrases(forms)})"] if forms else []), *of(MARK_SPANS)]), re.I)


MARKS = _mark_pattern()
MARKERS = {ch: _mark_pattern(ch) for ch in {f[0] for f in MARK_KINDS} | {ch for begin, _ in MARK_SIGN + MARK_SPANS for ch in begin}}


def _mark_words() -> re.Pattern:
    """A sign other than a letter or digit and a word or number that can open a mark."""
    words: dict[str, set[str]] = {}
    for head in _heads(list(MARK_KINDS)) + ["value", "per", "one", "half", "all", "a"]:
        words.setdefault(head[0], set()).add(head[1:])
    begin = "|".join([r"\d", *(f"[{ch}{ch.upper()}{FOLDED.get(ch, '')}](?i:{'|'.join(sorted(rests))})" for ch, rests in sorted(words.items()))])
    return re.compile(rf"\W(?={begin})")


MARK_WORDS, MARK_SIGNS = _mark_words(), re.compile("[$%]")


@lru_cache(10_000)
def _mark_kinds(word: str) -> list[str]:
    return MARK_KINDS[re.sub(r"[\s-]+", " ", word.lower())]


def marks(text: str, start: int, end: int) -> list[dict]:
    """What the words of a sentence do for the amounts in it, in order."""
    out, last = [], start
    # with the sign before the sentence, the place before a word in one is the place of the word in the other
    sentence = (text[start - 1] if start else " ") + text[start:end]
    places = [start + m.start() for m in MARK_WORDS.finditer(sentence)] + [m.start() for m in MARK_SIGNS.finditer(text, start, end)]
    for place in sorted(places):
        # a mark is only tried where it can begin, and behind the last one
        m = MARKERS.get(text[place].lower(), MARKS).match(text, place, end) if place >= last else None
        if m is None:
            continue
        last = m.end()
        kinds = ["derived", "unlike"] if m.lastgroup == "value" else [m.lastgroup] if m.lastgroup != "word" else _mark_kinds(m.group())
        out += [{"name": k, "at": m.start(), "to": m.end()} for k in kinds]
    return out


KINDS = {k for k, _, _ in RULES}
VALUES = {u + end for u in ("pct", "x", "usd") for end in ("", "_range")}
LEXERS, WORDS = _dispatch()
#: Where a lexeme can begin that is no word: a bracket, a dollar sign, a dash before a digit.
MARKED = re.compile(rf"[{DASHES}$(](?:(?<=[$(])|(?=\d))")

_FIELDS = [("kind", pa.string(), "string"), ("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("low", pa.float64(), "double"), ("high", pa.float64(), "double"), ("raw_low", pa.string(), "string"), ("raw_high", pa.string(), "string"), ("name", pa.string(), "string"),
           ("gap", pa.string(), "string"), ("after", pa.string(), "string"), ("line", pa.int32(), "int"), ("sentence", pa.int32(), "int"), ("sentence_start", pa.int32(), "int"), ("sentence_end", pa.int32(), "int"), ("left", pa.string(), "string"), ("right", pa.string(), "string"), ("written", pa.string(), "string"),
           ("marks", pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32()), ("to", pa.int32())])), "array<struct<name:string,at:int,to:int>>")]
LEXEME = pa.struct([(n, t) for n, t, _ in _FIELDS])
SCHEMA = f"array<struct<{','.join(f'{n}:{t}' for n, _, t in _FIELDS)}>>"


@lru_cache(10_000)
def parse_number(text: str) -> float:
    """The number of one end of a value: 9.0%, (1.0)%, negative 1.5 percent, $1,200.50, $2.5 million."""
    s = text.strip().lower()
    m = re.search(r"\d[\d,]*(?:\.\d+)?", s)
    if not m:
        raise ValueError(f"no number in {text!r}")
    below = s.startswith(("negative", "minus", "(", *DASHES))
    n = float(m.group().replace(",", "")) * next((f for w, f in SCALE.items() if w in s), 1.0)
    return -n if below else n


_named: dict[tuple, re.Pattern | None] = {}


def _names(filer: list[str] | None, other: list[str] | None) -> re.Pattern | None:
    """A pattern for a document's companies: names of several words in any case, single words with their capital, short capitals as they are."""
    key = (tuple(filer or ()), tuple(other or ()))
    if key not in _named:
        if len(_named) > 1000:
            _named.clear()

        def heads(name: str) -> str:
            ch = name[0]
            return f"{ch.lower()}{ch.upper()}{FOLDED.get(ch.lower(), '')}" if " " in name else ch

        def one(name: str) -> str:
            first, *rest = name.split()
            rest = [first[1:], *rest] if quick else [first, *rest]
            body = r"\s+".join(map(re.escape, rest))
            if not quick:
                return rf"\b(?i:{body})\b" if " " in name else rf"\b{body}\b" if name.isupper() else rf"\b{re.escape(name[0])}(?i:{re.escape(name[1:])})\b"
            return rf"(?<=[{heads(name)}])" + (rf"{body}\b" if " " not in name and name.isupper() else rf"(?i:{body})\b")

        every = [n for own in key for n in own]
        # a first letter that all names are sought by, if it is plain: a name then goes on behind it
        quick = all(re.match("[A-Za-z0-9]", n) for n in every)
        begin = "".join(sorted({ch for n in every for ch in heads(n)}))
        parts = [f"(?P<{kind}>{'|'.join(map(one, sorted(own, key=len, reverse=True)))})" for kind, own in zip(("filer", "counter"), key, strict=True) if own]
        pattern = "|".join(parts)
        _named[key] = re.compile(rf"[{begin}](?<!\w[{begin}])(?:{pattern})" if quick else pattern) if parts else None
    return _named[key]


def _hits(text: str, names: re.Pattern | None) -> list[tuple[int, int, str, re.Match]]:
    out, at = [], 0
    # a blank before the text makes the place before a word in one the place of the word in the other
    places = [m.start() for m in WORDS.finditer(" " + text)]
    marked = [m.start() for m in MARKED.finditer(text)]
    for i in sorted(places + marked) if marked else places:
        if i < at:
            continue
        hit = LEXERS[text[i]].match(text, i)
        if hit is not None and hit.end() > i:
            out.append((i, hit.end(), hit.lastgroup if hit.lastgroup in KINDS else next(k for k in KINDS if hit.groupdict().get(k)), hit))
            at = hit.end()
    if names is not None:
        out += [(m.start(), m.end(), m.lastgroup, m) for m in names.finditer(text)]
        out.sort(key=lambda x: x[0])
    return out


def _stops(text: str) -> list[tuple[int, int]]:
    """Where sentences end and the next ones begin."""
    return [(start if text[start] == "\n" else start + 1, end) for start, end in (m.span() for m in STOP.finditer(text))]


def lex(text: str, lines: list[dict] | None = None, names: re.Pattern | None = None) -> list[dict]:
    """The lexemes of a text in order.

    ``gap`` is the text since the last one, if it is short; ``line`` the start of its line, ``sentence`` counts stops. A value holds
    ``AROUND`` characters on both sides; its name is ``pro_forma`` if the short line above its own speaks of one. ``lines`` that can be
    headings are lexemes of kind line with their text as name and their linked share as low.
    """
    hits = _hits(text, names)
    heads = [(x["start"], x["end"], "line", x) for x in lines or () if x["end"] - x["start"] <= HEADING]
    if heads:
        hits = sorted(hits + heads, key=lambda x: (x[0], x[2] != "line"))
    out: list[dict] = []
    if not hits:
        return out
    stops = _stops(text)
    last, k, line, line_end = 0, 0, 0, text.find("\n")
    marked, of = None, []
    for start, end, kind, m in hits:
        while k < len(stops) and stops[k][0] < start:
            k += 1
        while 0 <= line_end < start:
            line, line_end = line_end + 1, text.find("\n", line_end + 1)
        until = line_end if line_end >= 0 else len(text)
        row = {"kind": kind, "start": start, "end": end, "after": text[end : end + AFTER], "line": line, "sentence": k, "sentence_start": stops[k - 1][1] if k else 0, "sentence_end": stops[k][0] if k < len(stops) else len(text)}
        if kind == "line":
            row["name"], row["low"] = text[start:end], m["linked"]
            out.append(row)
            continue
        row["gap"] = text[last:start] if 0 <= start - last <= GAP else None
        if kind == "house":
            row["name"] = FORMS.get(" ".join(m.group().split()))
            row["raw_low"] = "acts" if NEXT_ACT.match(text, end, end + 120) else None
        elif kind.startswith("analysis_"):
            row["kind"], row["name"] = "analysis", "other" if kind == "analysis_chosen" else kind[9:]
            row["raw_low"] = "strong" if until - line <= SHORT_LINE or start - line <= LINE_START else None
        elif kind in ("pct", "x", "usd") or kind.endswith("_range"):
            unit, _, ranged = kind.partition("_")
            low, high = (m.group(f"low_{unit}"), m.group(f"high_{unit}")) if ranged else (m.group(), m.group())
            row["left"], row["right"], row["written"] = text[max(0, start - AROUND) : start], text[end : end + AROUND], m.group()
            if unit == "usd":
                if marked != k:
                    marked, of = k, marks(text, row["sentence_start"], row["sentence_end"])
                row["marks"] = of
            above = text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)] if line else ""
            row["name"] = "pro_forma" if len(above) < ABOVE and PRO_FORMA.search(above) else None
            if ranged and out and out[-1].get("low") is not None and out[-1]["kind"] != "line" and row["gap"] and row["gap"].strip() == "," and AND.search(m.group()):
                # after a comma, two values with "and" between them are the last of a list, not a range
                middle, second = m.start(f"low_{unit}") + len(low.rstrip()), m.start(f"high_{unit}")
                out.append(row | {"kind": unit, "end": middle, "after": text[middle : middle + AFTER], "right": text[middle : middle + AROUND], "written": text[start:middle], "low": parse_number(low), "high": parse_number(low), "raw_low": low.strip(), "raw_high": low.strip()})
                row |= {"kind": unit, "start": second, "gap": text[middle:second], "left": text[max(0, second - AROUND) : second], "written": text[second:end]}
                low = high
            row["low"], row["high"], row["raw_low"], row["raw_high"] = parse_number(low), parse_number(high), low.strip(), high.strip()
        out.append(row)
        last = max(last, end)
    return out


def thinned(found: list[dict]) -> list[dict]:
    """Lexemes without the parties that no value looks at: of those between two values, the first is near the one and the last near the other."""
    out: list[dict | None] = []
    run: list[int] = []
    for x in found:
        if x["kind"] in VALUES:
            run = []
        elif x["kind"] in ("filer", "counter"):
            if len(run) > 1:
                out[run.pop()] = None
            run.append(len(out))
        out.append(x)
    return [x for x in out if x is not None]


def _arrow(found: list[list[dict]]) -> pa.Array:
    """Lexemes of texts, a field at a time: Arrow takes much longer for rows that are dictionaries."""
    rows = [x for own in found for x in own]
    fields = [pa.array([x.get(n) for x in rows], t) for n, t, _ in _FIELDS]
    ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(LEXEME)))


def dealt(docs: DataFrame, *doc: str) -> DataFrame:
    """Documents dealt to all tasks of a shuffle by their key, however few files they lie in."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *doc)


def lexemes(docs: DataFrame, text: str, *keep: str, prefilter: bool = True, lines: str | None = None, filer: str | None = None, other: str | None = None, outer: bool = False, by: tuple[str, ...] = (), thin: bool = False) -> DataFrame:
    """One row for each lexeme: columns ``keep``, n (its number in the document) and the fields of a lexeme.

    ``lines``: a column of lines, to have those that can be headings; ``filer`` and ``other``: columns of names of the filing
    company and of others. A null or empty text has no lexemes, nor has one without any word or sign that could open a value: a
    native test keeps such texts from the helper (``prefilter``; houses of other texts are then not found). With ``outer`` a
    document without lexemes has one row of nulls. ``by``, the documents' key: lexemes are dealt by it while a
    document's are one row, so that windows by document need no further shuffle. ``thin`` leaves out parties that are next to no value; n then counts
    the others. Texts that lie in few files are better ``dealt`` before.
    """
    whole = F.col(text).cast("string")
    if prefilter:
        # a plain word first: a pattern of many alternatives takes long where all of them come late
        whole = F.when(whole.contains("discount") | whole.rlike(ANCHORS), whole)
    more = {"lines": lines, "filer": filer, "other": other}
    # only columns that there are: Spark measures a batch after each row, and that takes long for arrays of nulls
    given = [k for k, c in more.items() if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                texts, *rest = (c.to_pylist() for c in part.columns[n_kept:])
                of, none = dict(zip(given, rest, strict=True)), [None] * len(texts)
                ls, a, o = (of.get(k, none) for k in more)
                every = [lex(t, x, _names(f, c)) if t else [] for t, x, f, c in zip(texts, ls, a, o, strict=True)]
                found = _arrow([*map(thinned, every)] if thin else every)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], found], names=[*part.schema.names[:n_kept], "lexemes"])

    kept, n_kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in docs.select(*keep).schema), len(keep)
    rows = docs.select(*keep, whole.alias("__text"), *[F.col(more[k]).alias(f"__{k}s") for k in given]).mapInArrow(run, f"{kept}lexemes {SCHEMA}")
    rows = dealt(rows, *by) if by else rows
    return rows.select(*keep, (F.posexplode_outer if outer else F.posexplode)("lexemes").alias("n", "x")).select(*keep, "n", "x.*")

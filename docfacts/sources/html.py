"""HTML documents to text with a run-length map back to the source.

Positions are code points of the text; each run (text_pos, html_pos, len) says that ``len`` characters from ``text_pos`` on
stand in the source from ``html_pos`` on. One Arrow UDF converts a document; everything after it is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import as_of_by_key

# Elements that break a line, whose text is left out, and that have no end tag.
BREAKING = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody tfoot thead tr ul".split()
)
HIDDEN = frozenset("script style head title".split())
EMPTY = frozenset("br hr img input link meta area base col embed source track wbr".split())
# Characters that become another or none.
SPACES, NOTHING, QUOTES = "      ", "​­", {"‘": "'", "’": "'", "“": '"', "”": '"'}
CHARACTERS = str.maketrans({**dict.fromkeys(SPACES, " "), **dict.fromkeys(NOTHING, ""), **QUOTES})
# Lines that page breaks leave behind, and ends of a finished sentence.
PAGE_LINE = re.compile(r"\d{1,3}|[ivxlc]{1,6}|[a-z]-\d{1,3}|- *\d{1,3} *-|table of contents|index to (consolidated )?financial statements", re.I)
FINISHED = tuple('.;:!?")')
HEAVY = re.compile(r"font-weight\s*:\s*(?:bold|[6-9]00)", re.I)

SCHEMA = "text string, lines array<struct<start:int,end:int,bold:double,linked:double>>, runs array<struct<text_pos:int,html_pos:int,len:int>>"


class _Lines(HTMLParser):
    """Lines as lists of (text, source position, bold, linked) fragments."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.lines: list[list[tuple[str, int, bool, bool]]] = [[]]
        self.open: list[tuple[str, bool, bool]] = []
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _put(self, text: str, at: int) -> None:
        if any(tag in HIDDEN for tag, _, _ in self.open):
            return
        bold, linked = any(b for _, b, _ in self.open), any(x for _, _, x in self.open)
        for m in re.finditer(r"\s+|\S+", text):
            piece = " " if m.group().isspace() else m.group()
            line = self.lines[-1]
            if piece == " " and (not line or line[-1][0].endswith(" ")):
                continue
            line.append((piece, at + m.start(), bold, linked))

    def _break(self) -> None:
        if self.lines[-1]:
            self.lines.append([])

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in BREAKING:
            self._break()
        if tag in ("td", "th") and self.lines[-1]:
            self._put(" | ", self._at())
        if tag not in EMPTY:
            self.open.append((tag, tag in ("b", "strong", "th") or bool(HEAVY.search(values.get("style") or "")), tag == "a" and "href" in values))

    def handle_startendtag(self, tag, attrs):
        if tag in BREAKING:
            self._break()

    def handle_endtag(self, tag):
        if tag in BREAKING:
            self._break()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        at = self._at()
        for m in re.finditer(f"[{NOTHING}]|[^{NOTHING}]+", data):
            if m.group() not in NOTHING:
                self._put(m.group().translate(CHARACTERS), at + m.start())

    def handle_entityref(self, name):
        self._put(html5.get(f"{name};", f"&{name};").translate(CHARACTERS), self._at())

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            ch = bytes([code]).decode("cp1252") if 128 <= code <= 159 else chr(code)
        except (ValueError, OverflowError, UnicodeDecodeError):
            return
        self._put(ch.translate(CHARACTERS), self._at())


def decode_bytes(raw: bytes) -> str:
    """UTF-8, or else Windows-1252 with replacements."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def convert(source: str) -> tuple[str, list[dict], list[dict]]:
    """(text, lines, runs) of an HTML document; page furniture is left out and paragraphs it broke are joined."""
    text, lines, runs, size = [], [], [], 0
    broken = False
    for fragments in _Lines(source).lines:
        while fragments and fragments[-1][0] == " ":
            fragments.pop()
        if not fragments:
            continue
        if PAGE_LINE.fullmatch(re.sub(r"\s+", " ", "".join(f[0] for f in fragments))):
            broken = True
            continue
        join = broken and bool(text) and not text[-1].endswith(FINISHED)
        broken = False
        if lines:
            text.append(" " if join else "\n")
            size += 1
        start = size
        for piece, at, _, _ in fragments:
            last = runs[-1] if runs else None
            if last and last["text_pos"] + last["len"] == size and last["html_pos"] + last["len"] == at:
                last["len"] += len(piece)
            else:
                runs.append({"text_pos": size, "html_pos": at, "len": len(piece)})
            text.append(piece)
            size += len(piece)
        width = size - start
        share = lambda k, f=fragments, w=width: sum(len(x[0]) for x in f if x[k]) / w
        new = {"start": start, "end": size, "bold": share(2), "linked": share(3)}
        if join:
            old = lines.pop()
            before = old["end"] - old["start"]
            new = {"start": old["start"], "end": size, **{k: (old[k] * before + new[k] * width) / (before + width) for k in ("bold", "linked")}}
        lines.append(new)
    return "".join(text) + "\n", lines, runs


def html_to_document(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and text, lines, runs of each document; ``html`` is text or bytes; a null one is an empty document.

    Documents are dealt to all tasks first: many small ones lie in few files, and their conversion is all the work.
    """
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keep[:1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 32):  # documents are large
                part = b.slice(i, 32)
                docs = [convert("" if s is None else decode_bytes(s) if isinstance(s, bytes) else s) for s in part.column(part.num_columns - 1).to_pylist()]
                line = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bold", pa.float64()), ("linked", pa.float64())])
                run_ = pa.struct([("text_pos", pa.int32()), ("html_pos", pa.int32()), ("len", pa.int32())])
                made = [pa.array([d[0] for d in docs], pa.string()), pa.array([d[1] for d in docs], pa.list_(line)), pa.array([d[2] for d in docs], pa.list_(run_))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "text", "lines", "runs"])

    kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in pages.select(*keep).schema)
    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, kept + SCHEMA)


def html_offset(runs: Column, position: Column) -> Column:
    """Source position of a text position; null on line breaks, which have none."""
    hit = F.filter(runs, lambda r: (r["text_pos"] <= position) & (position < r["text_pos"] + r["len"]))
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)["html_pos"] + position - F.element_at(hit, 1)["text_pos"])


def html_offsets(positions: DataFrame, docs: DataFrame, key: str, position: str = "position", name: str = "html_pos") -> DataFrame:
    """``positions`` (key, position, ...) with the place of each in its document's source, for any number of positions at once.

    A document's runs are a step function: they and the positions are merged in order, and each position takes the last run
    that starts at or before it. One shuffle by document, no join; null on line breaks, outside the text, for unknown documents and null positions.
    """
    runs = docs.select(key, F.explode("runs").alias("__run")).select(key, F.col("__run.text_pos").alias("__from"), F.col("__run.html_pos").alias("__source"), F.col("__run.len").alias("__len"))
    last = as_of_by_key(positions, runs, [key], position, "__from", ["__source", "__len"], strict=False)
    away = F.col(position) - F.col("__from_at")
    return last.withColumn(name, F.when(away < F.col("__len"), F.col("__source") + away)).drop("__source", "__len", "__from_at")


def line_at(lines: Column, position: Column) -> Column:
    """Number, from 0, of the last line that starts at or before a position."""
    return F.greatest(F.lit(0), F.size(F.filter(lines, lambda x: x["start"] <= position)) - 1)


def snippet(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)

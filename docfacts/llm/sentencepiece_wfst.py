"""SentencePiece encoding and decoding by weighted finite-state transducers.

Method. A model is compiled into transducers, each a machine of its own (``start``, ``step``, ``final``):

* ``Characters``: the normaliser. A precompiled character map becomes a trie; the state is the text since the last
  output, and the longest match is put out when no longer one can follow.
* ``Spaces``: white space to U+2581, with the dummy prefix, runs as one and ends dropped where the model says so.
* ``Pieces``: a trie walk that puts out a piece's id at each of its ends and weighs its negative score; a character of no piece
  goes through arcs for its UTF-8 bytes (byte fallback), or to the unknown id.
* ``Pairs``, for BPE models: a segmentation is the one BPE makes exactly if every two neighbouring pieces are what BPE makes
  of their joint text. The acceptor's state is the last piece; an arc weighs 0 where the next piece may follow and
  infinity where not. Its arcs are compiled when first needed.

``compose`` joins machines on the fly, and ``shortest`` is the tropical-semiring shortest path of an input through one. The
encoder finds the shortest path of the same composition, cut where no piece can span: the normaliser's output falls into
words, and a word's path through pieces and pairs is kept in a bounded cache. Where arcs weigh 0 or are absent, as in BPE's
composition, the first complete path is a shortest one, so the search may go depth first (``first_path``). Tests hold machines, compositions and encoder to each other and to the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of a Python worker's caches of words and of piece pairs; each is emptied when full.
CACHE_WORDS, CACHE_PAIRS = 900_000, 1_000_000
#: Penalty of an unknown character below the least score, as in unigram models.
UNKNOWN_PENALTY = 10.0

# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            x = data[at]
            at += 1
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces (text, score, type) and settings of a model file; ``charsmap`` is its precompiled character map."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, strip: bool = False, escape: bool = True, charsmap: bytes = b""):
        self.pieces, self.kind, self.dummy_prefix, self.strip, self.escape, self.charsmap = pieces, kind, dummy_prefix, strip, escape, charsmap

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, kind, norm = [], UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                score = np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]
                pieces.append((p.get(1, b"").decode(), float(score), p.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
        return cls(pieces, kind, bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)), norm.get(2, b""))


def characters_of(charsmap: bytes) -> dict[str, str]:
    """The replacements of a precompiled character map: a double-array trie over UTF-8 bytes, then zero-ended texts.

    A unit of the array holds a byte label in its low bits, whether a value hangs below it (bit 8) and the offset to its children.
    """
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64)
    texts = charsmap[4 + size :]
    below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    out: dict[str, str] = {}
    stack = [(int(below(units[0])), b"")]
    codes = np.arange(1, 256)
    while stack:
        at, key = stack.pop()
        places = at ^ codes
        inside = places < len(units)
        found = codes[inside][(units[places[inside]] & 0x800000FF) == codes[inside]]
        for c in found.tolist():
            unit = int(units[at ^ c])
            child = (at ^ c) ^ below(unit)
            if unit & 256:
                value = int(units[child]) & 0x7FFFFFFF
                out[(key + bytes([c])).decode()] = texts[value : texts.index(b"\0", value)].decode()
            stack.append((child, key + bytes([c])))
    return out


Arc = tuple[tuple, float, object]  # outputs, weight, next state


class Characters:
    """The normaliser: longest matches of a character map are replaced, other characters stay."""

    start = ""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.opens = {k[:i] for k in table for i in range(1, len(k) + 1)}

    def _settle(self, held: str, more: bool) -> tuple[str, str]:
        """(output, still held): what is decided of a held text; with ``more`` to come a text that opens a longer match waits."""
        out = ""
        while held and not (more and held in self.opens):
            n = next((i for i in range(len(held), 0, -1) if held[:i] in self.table), 0)
            out += self.table[held[:n]] if n else held[0]
            held = held[n or 1 :]
        return out, held

    def step(self, state: str, ch: str) -> list[Arc]:
        if not state and ch not in self.opens:
            return [((ch,), 0.0, "")]
        out, held = self._settle(state + ch, True)
        return [(tuple(out), 0.0, held)]

    def final(self, state: str) -> tuple[tuple, float]:
        return tuple(self._settle(state, False)[0]), 0.0


class Spaces:
    """White space: escaped, with a dummy prefix, and with runs and ends dropped if ``strip``. State: (begun, held, last was a space)."""

    start = (False, "", True)

    def __init__(self, dummy_prefix: bool, strip: bool, escape: bool):
        self.prefix, self.strip, self.mark = dummy_prefix, strip, SPACE if escape else " "

    def step(self, state: tuple[bool, str, bool], ch: str) -> list[Arc]:
        begun, held, space = state
        if ch == " " and self.strip and space:
            return [((), 0.0, state)]
        lead = "" if begun or not self.prefix else self.mark
        new = self.mark if ch == " " else ch
        if self.strip and new == self.mark:  # dropped if nothing else follows
            return [((), 0.0, (True, held + lead + new, ch == " "))]
        return [(tuple(held + lead + new), 0.0, (True, "", False))]

    def final(self, state) -> tuple[tuple, float]:
        return (), 0.0


class Pieces:
    """Characters to piece ids; states are nodes of the trie of pieces, 0 (the root) between pieces."""

    start = 0

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self.bpe = encoder.model.kind == BPE
        #: The arcs out of each node by character; of no piece's characters only where a piece begins with them.
        self.table = [{ch: self._arcs(state, ch, node) for ch, node in below.items()} for state, below in enumerate(encoder.below)]

    def _fallback(self, ch: str) -> Arc:
        return tuple(self.e.fallback(ch)), 0.0 if self.bpe else -self.e.floor, 0

    def _arcs(self, state: int, ch: str, node: int) -> list[Arc]:
        piece, arcs = self.e.ends[node], []
        if piece >= 0:
            arcs.append(((piece,), 0.0 if self.bpe else -self.e.score[piece], 0))
        elif not state:
            arcs.append(self._fallback(ch))
        if self.e.below[node]:
            arcs.append(((), 0.0, node))
        return arcs

    def step(self, state: int, ch: str) -> list[Arc]:
        arcs = self.table[state].get(ch)
        return arcs if arcs is not None else [] if state else [self._fallback(ch)]

    def final(self, state: int) -> tuple[tuple, float] | None:
        return None if state else ((), 0.0)


class Pairs:
    """Accepts sequences of ids in which each piece may follow the one before it; ids of no piece separate."""

    start = -1

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self.free = {*encoder.byte_ids.values(), encoder.unknown}
        self.arcs: dict[int, list[Arc]] = {}

    def step(self, last: int, piece: int) -> list[Arc]:
        if last >= 0 and piece not in self.free:
            may = self.e.pairs.get(last << 32 | piece)
            if not (self.e.follows(last, piece) if may is None else may):
                return []
        arcs = self.arcs.get(piece)
        if arcs is None:
            arcs = self.arcs[piece] = [((piece,), 0.0, -1 if piece in self.free else piece)]
        return arcs

    def final(self, last: int) -> tuple[tuple, float]:
        return (), 0.0


class compose:  # noqa: N801
    """The machine that feeds the outputs of one machine to another, built as far as an input needs it."""

    def __init__(self, first, second):
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def _feed(self, outputs: tuple, weight: float, state) -> list[Arc]:
        ways = [((), weight, state)]
        for x in outputs:
            ways = [(out + more, w + v, nxt) for out, w, at in ways for more, v, nxt in self.second.step(at, x)]
        return ways

    def step(self, state: tuple, x) -> list[Arc]:
        one, two = state
        arcs = []
        for given, v, nxt in self.first.step(one, x):
            if not given:
                arcs.append(((), v, (nxt, two)))
            elif len(given) == 1:
                for out, w, at in self.second.step(two, given[0]):
                    arcs.append((out, v + w, (nxt, at)))
            else:
                arcs += [(out, w, (nxt, at)) for out, w, at in self._feed(given, v, two)]
        return arcs

    def final(self, state: tuple) -> tuple[tuple, float] | None:
        last = self.first.final(state[0])
        ends = []
        for out, w, at in self._feed(*last, state[1]) if last is not None else []:
            more = self.second.final(at)
            if more is not None:
                ends.append((w + more[1], out + more[0]))
        return min(ends, key=lambda x: x[0])[::-1] if ends else None


def shortest(machine, inputs) -> tuple[tuple, float] | None:
    """(outputs, weight) of the least-weight path of a sequence through a machine; of equal ones the longest last pieces win."""
    front: dict[object, tuple[float, tuple]] = {machine.start: (0.0, ())}  # outputs as a linked list, last first
    for x in inputs:
        after: dict[object, tuple[float, tuple]] = {}
        for state, (weight, path) in front.items():
            for out, w, nxt in machine.step(state, x):
                old = after.get(nxt)
                if old is None or weight + w <= old[0]:
                    after[nxt] = (weight + w, (path, out) if out else path)
        # states come newest first, so that of equal paths the one whose last piece began first is kept
        front = after
    best = None
    for state, (weight, path) in front.items():
        end = machine.final(state)
        if end is not None and (best is None or weight + end[1] < best[0]):
            best = (weight + end[1], (path, end[0]))
    if best is None:
        return None
    parts, path = [], best[1]
    while path:
        path, out = path
        parts.append(out)
    return tuple(x for out in reversed(parts) for x in out), best[0]


def first_path(machine: compose, inputs) -> tuple[tuple, float] | None:
    """What ``shortest`` gives for a composition whose arcs all weigh 0: any path to the end.

    Depth first, of a state's arcs the last one first. Outputs are fed to the second machine when their path is gone on with;
    no state behind an output is tried twice at a place.
    """
    n, step, feed = len(inputs), machine.first.step, machine.second.step
    # place, states of both machines, outputs not yet fed, outputs of the path as a linked list
    stack: list[tuple] = [(0, *machine.start, (), ())]
    tried = set()
    while stack:
        at, one, two, given, path = stack.pop()
        while True:
            if given:
                arcs = feed(two, given[0]) if len(given) == 1 else machine._feed(given, 0.0, two)
                if not arcs:
                    break
                for out, _, nxt in arcs[:-1]:
                    stack.append((at, one, nxt, (), (path, out)))
                out, _, two = arcs[-1]
                if (at, one, two) in tried:
                    break
                tried.add((at, one, two))
                path = (path, out)
            if at == n:
                end = machine.final((one, two))
                if end is None:
                    break
                parts = [end[0]]
                while path:
                    path, out = path
                    parts.append(out)
                return tuple([x for out in reversed(parts) for x in out]), 0.0
            arcs = step(one, inputs[at])
            if not arcs:
                break
            at += 1
            for given, _, nxt in arcs[:-1]:
                stack.append((at, nxt, two, given, path))
            given, _, one = arcs[-1]
    return None


class Encoder:
    """Texts to ids and back for one model."""

    def __init__(self, model: Model):
        self.model = model
        #: The trie of pieces: each node's children, and the piece that ends there or -1.
        self.below: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.byte_ids = {}
        self.unknown = 0
        self.texts: list[str] = []
        self.best: dict[str, float] = {}
        self.score = [s for _, s, _ in model.pieces]
        raw: list[bytes] = []
        for i, (text, score, kind) in enumerate(model.pieces):
            self.texts.append(text)
            if kind in (NORMAL, USER_DEFINED):
                node = 0
                for ch in text:
                    if ch not in self.below[node]:
                        self.below[node][ch] = len(self.below)
                        self.below.append({})
                        self.ends.append(-1)
                    node = self.below[node][ch]
                self.ends[node] = i
                self.best[text] = score
            elif kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            raw.append({BYTE: lambda t=text: bytes([int(t[1:-1], 16)]), CONTROL: lambda: b"", UNKNOWN: lambda: " ⁇ ".encode()}.get(kind, lambda t=text: t.replace(SPACE, " ").encode())())
        self.raw = raw
        # white space only opens pieces: then words are independent
        self.by_word = all(SPACE not in t.lstrip(SPACE) for t in self.best)
        self.floor = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.characters = Characters(characters_of(model.charsmap)) if model.charsmap else None
        self.spaces = Spaces(model.dummy_prefix, model.strip, model.escape)
        #: From normalised characters to ids.
        self.pieces = compose(Pieces(self), Pairs(self)) if model.kind == BPE else Pieces(self)

    def normaliser(self):
        return compose(self.characters, self.spaces) if self.characters else self.spaces

    def machine(self):
        """The whole composition, from characters of a text to ids."""
        return compose(self.normaliser(), self.pieces)

    def fallback(self, ch: str) -> list[int]:
        """Ids of a character of no piece."""
        return [self.byte_ids[b] for b in ch.encode()] if self.byte_ids else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a text, by merging the pair of the best score, leftmost first; defines the pair acceptor."""
        parts = list(text)
        best = self.best
        while len(parts) > 1:
            top, at = None, -1
            for i in range(len(parts) - 1):
                s = best.get(parts[i] + parts[i + 1])
                if s is not None and (top is None or s > top):
                    top, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the acceptor has an arc from piece a to piece b."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            x, y = self.texts[a], self.texts[b]
            got = self.pairs[key] = self.merged(x + y) == [x, y]
        return got

    def path(self, text: str) -> tuple[int, ...]:
        """Ids of the shortest path for a normalised text."""
        return (first_path if self.model.kind == BPE else shortest)(self.pieces, text)[0]

    def _word(self, text: str) -> bytes:
        return np.array(self.path(text), dtype="<i4").tobytes()

    def _joined(self, parts: list[bytes]) -> bytes:
        """Ids of consecutive words; unknown characters in a row are one unknown id."""
        data = b"".join(parts)
        if self.byte_ids:
            return data
        ids = np.frombuffer(data, "<i4")
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def _normal(self, text: str) -> bytes:
        """Ids of a normalised text."""
        if not self.by_word:
            return self._joined([self._word(text)])
        out, words = [], self.words
        for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text):
            got = words.get(" " + w)
            if got is None:
                got = words[" " + w] = self._word(w)
            out.append(got)
        return self._joined(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32 bytes."""
        m, words = self.model, self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        if self.characters or m.strip or not m.escape:
            # the normaliser is deterministic: its one path is the normalised text
            return self._normal("".join(shortest(self.normaliser(), text)[0]))
        text = text.replace(SPACE, " ")
        if not text:
            return b""
        if not (self.by_word and m.dummy_prefix):
            return self._normal((SPACE if m.dummy_prefix else "") + text.replace(" ", SPACE))
        mark = SPACE
        out = []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            # each part follows a space, but for those that begin with a line feed put apart here
            parts = text.replace("\n", " \n").split(" ")
            if parts[0] == "":
                parts[0] = " "
            for w in parts:
                got = words.get(w)
                if got is None:
                    got = words[w] = self._word(mark if w in ("", " ") else w if w[0] == "\n" else mark + w)
                out.append(got)
        else:
            return self._normal((SPACE + text).replace(" ", SPACE))
        return self._joined(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space before the first word is taken away, ids out of range are unknown."""
        n = len(self.raw)
        data = b"".join([self.raw[i] if 0 <= i < n else self.raw[self.unknown] for i in ids])
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(Model.load(path))
    return _encoders[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, round_trip) for each document.

    ids_crc32 is over little-endian unsigned 32-bit ids; round_trip says whether the ids decode to the text (U+2581
    in a text decodes to a space). Null text: null ids and round_trip, n_ids 0, ids_crc32 that of nothing; empty text:
    no ids. Null doc_id and repeated rows are encoded each. Very long texts are encoded whole. An empty table gives an
    empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                data = [None if t is None else enc.encode(t) for t in texts]
                sizes = [0 if d is None else len(d) // 4 for d in data]
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([*(d is None for d in data), False]))
                flat = np.frombuffer(b"".join(d for d in data if d), dtype="<i4")
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                lists = np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []
                same = [None if t is None else enc.decode(x.tolist()) == t for t, x in zip(texts, lists, strict=True)]
                crc = [zlib.crc32(d or b"") for d in data]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``text`` to rows that hold an array of ids; null ids decode to null, no ids to an empty text."""

    @F.pandas_udf("string")
    def text(column):
        enc = encoder(model_path)
        return column.map(lambda x: None if x is None else enc.decode([int(i) for i in x]))

    return rows.withColumn("text", text(F.col(ids)))

"""Byte-level BPE by a tokenization automaton.

Method: the automaton reads tokens and accepts exactly the token sequences that the merges make. It starts as one state with an
arc for every byte. Each merge u v -> w, in order of rank, adds one gadget: the arcs of u are led to a copy of their state that
lacks the arc of v, and every state with an arc of u gets an arc of w to the state that v led to. All arcs of a token lead to one
state, so a state is a token and the gadget up to which its copies were made, and a gadget is three numbers; whether a state has
an arc follows from them and is kept in a table once asked.

A pre-split word is the labels of one path only. The encoder walks it by table: from a state it takes the longest token of the
word that has an arc, and remembers places from which no path reaches the end. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a Python worker's cache of words, with those of an entry, and arcs that its table keeps (about 100 bytes each); each is emptied
#: when full, and may be exceeded by the words of one text.
CACHE_BYTES = 120_000_000
ENTRY = 180
CACHE_ARCS = 500_000
#: Texts that one step takes together.
BATCH = 64

SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for texts up to U+024F, whose letters and numbers are the same in all versions of Unicode; compiled for ``re``, which is faster.
LATIN = "\u024f"
LETTERS, NUMBERS = ("".join(chr(i) for i in range(ord(LATIN) + 1) if unicodedata.category(chr(i))[0] == k) for k in "LN")
LATIN_SPACE = r"\t-\r \x85\xa0"
LATIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{LATIN_SPACE}{LETTERS}{NUMBERS}]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 is itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of ``merges``: pairs of ids and the id that they make, in order of rank.

    ``bytes_of``: id -> the label of its arcs; ids without a merge are single bytes. Gadget k happens at two times: at 2k + 1 the
    arcs of u lead to the copy, at 2k + 2 the arcs of w appear. A token's state is the one that its arcs lead to.
    """

    def __init__(self, bytes_of: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.label = bytes_of
        n = max(bytes_of) + 1
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.gone: dict[int, int] = {}  # (state's token, arc's token) -> time from which the state lacks the arc
        self.now = 2 * len(merges) + 3
        live = {i for i, b in bytes_of.items() if len(b) == 1}
        for k, (u, v, w) in enumerate(merges):
            if u in live and v in live and w not in live and self.has_arc(u, 2 * k + 1, v):
                self.gone[u << 32 | v] = 2 * k + 1
                self.left[w], self.right[w], self.born[w] = u, v, 2 * k + 2
                live.add(w)
        self.token = {bytes_of[i]: i for i in live}
        # labels as a trie: node and byte -> node, the longest token along each node, and each token's longest proper prefix
        self.goto: dict[int, int] = {}
        self.along, self.size, self.shorter = [-1], [0] * n, [-1] * n
        for text in sorted(self.token):
            node = 0
            for b in text:
                to = self.goto.get(node << 8 | b)
                if to is None:
                    to = self.goto[node << 8 | b] = len(self.along)
                    self.along.append(self.along[node])
                node = to
            t = self.token[text]
            self.shorter[t], self.along[node], self.size[t] = self.along[node], t, len(text)
        self.table: dict[int, bool] = {}

    def has_arc(self, state: int, time: int, token: int) -> bool:
        """Whether the state that ``state`` led to at ``time`` has an arc of ``token``."""
        left, right, born, gone = self.left, self.right, self.born, self.gone
        while True:
            cut = gone.get(state << 32 | token)
            if cut is not None and cut <= time:
                return False
            t, s = born[token], born[state]
            if t < 0 and s < 0:
                return True
            if t >= s:  # the arc came by a gadget: to all states that had one of its left part then
                time, token = t, left[token]
            else:  # the state is older than its token: its right part led there before that gadget
                time, state = s - 2, right[state]

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that is labelled ``word``."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        goto, along, shorter, size, table, n = self.goto.get, self.along, self.shorter, self.size, self.table, len(word)
        if len(table) > CACHE_ARCS:
            table.clear()
        out: list[int] = []
        dead: set[int] = set()
        at, state = 0, -1
        while at < n:
            node, i = 0, at
            while i < n and (to := goto(node << 8 | word[i])) is not None:
                node = to
                i += 1
            t = along[node]
            while t >= 0:
                if not dead or at + size[t] not in dead:
                    if state < 0:
                        break
                    arc = table.get(state << 32 | t)
                    if arc is None:
                        arc = table[state << 32 | t] = self.has_arc(state, self.now, t)
                    if arc:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += size[t]
            else:  # no path from here: every prefix of a word has one path, so none comes back to this place
                dead.add(at)
                t = out.pop()
                at -= size[t]
            state = out[-1] if out else -1
        return out


class Encoder:
    """Ids of texts by the automaton of a byte-level BPE file, equal to those of its own library.

    ``special``: whether strings of special tokens inside a text are these tokens, or plain text.
    """

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = dict(labels) | {i: t.encode() for t, i in added.items()}
        self.label_of = np.array([self.labels.get(i, b"") for i in range(max(self.labels) + 1)], dtype=object)
        self.added = added if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self._splitter = None

    def _split(self, text: str) -> list[str]:
        letters = set(text)
        if max(letters) <= LATIN:
            return LATIN_WORDS.findall(text)
        # characters that the tables of this Python don't know may be letters for the library
        if not any(unicodedata.category(c) == "Cn" for c in letters):
            return WORDS.findall(text)
        if self._splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def _ids(self, text: str) -> bytes:
        words, cache = self._split(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            if self.held > CACHE_BYTES:
                cache.clear()
                self.held = 0
            path = self.automaton.path
            for w in words:
                if w not in cache:
                    made = cache[w] = array("I", path(w.encode())).tobytes()
                    self.held += ENTRY + len(w) + len(made)
            return b"".join(map(cache.__getitem__, words))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as uint32; none for null and empty texts."""
        if not text:
            data = b""
        elif self.cut is None or "<" not in text:
            data = self._ids(text)
        else:
            data = b"".join(array("I", [self.added[x]]).tobytes() if i % 2 else self._ids(x) for i, x in enumerate(self.cut.split(text)) if x)
        return np.frombuffer(data, dtype=np.uint32)

    def emit(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, joined."""
        return b"".join(self.label_of[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``emit``; bytes that are no UTF-8 become U+FFFD."""
        return self.emit(ids).decode("utf-8", "replace")


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for a Python worker, kept from task to task."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of each row.

    Null and empty texts have no ids. Null and repeated doc_id: each row is encoded as it is. Texts are encoded whole, whatever
    their length. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                ids = [enc.encode(t).astype(np.int32) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the labels of the ids. No ids: the empty text; null ids: a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                texts = [enc.decode(x.values.to_numpy()) if x.is_valid else None for x in part["ids"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, from its ids and from the text that these decode to.

    Edge cases are those of ``encode``; a null text is the empty text here. Ids never leave the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        digits = np.array([b"%d" % i for i in range(len(enc.label_of))], dtype=object)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                n, made, back = [], [], []
                for t in part["text"].to_pylist():
                    ids = enc.encode(t)
                    n.append(len(ids))
                    made.append(hashlib.sha256(b",".join(digits[ids].tolist())).hexdigest())
                    back.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(made), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

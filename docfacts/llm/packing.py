"""Packing of tokenised documents into training windows by best-fit decreasing.

Method: a document longer than a window is first cut into full windows; what remains of each document is
put, longest first, into the open window with the least room that still holds it. A segment tree indexed by
remaining capacity finds that window in O(log capacity). Remainders are dealt into shards of about
``SHARD_DOCS`` documents by a hash of their row, so that any number of executors pack side by side; a shard
wastes at most its few last windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
SHARD_DOCS = 2048
#: Entries of the word cache of a Python worker (about 200 bytes each); it is emptied when full.
CACHE_WORDS = 600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of texts as little-endian uint32 bytes, equal to ``Tokenizer.encode(text).ids``.

    The tokenizer of ``path`` splits at white space before it merges, so the ids of a text are those of its
    parts between spaces and line feeds. Parts are looked up in a bounded cache; those not in it are
    encoded in one call for a batch of texts. ASCII letters are lower-cased first, as the tokenizer would.
    A text with ``<|`` could hold a special token's string and is encoded as a whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.limit = cache_words

    def _encode(self, words: list[bytes]) -> None:
        if not words:
            return
        got = self.tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4").tobytes()
        of = np.array([-1 if x is None else x for x in got.word_ids], dtype=np.int64)
        ends = np.cumsum(np.bincount(of[of >= 0], minlength=len(words))) * 4
        at = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.cache[w] = ids[at:end]
            at = end

    def batch(self, texts: list[str | None]) -> list[bytes]:
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        whole = {i for i, t in enumerate(texts) if t and "<|" in t}
        parts = [[] if not t or i in whole else t.encode("utf-8", "replace").lower().replace(b"\n", b" ").split(b" ") for i, t in enumerate(texts)]
        new = set()
        for p in parts:
            new.update(p)
        new = [w for w in new if w not in cache]
        ended = [w for w in new if len(w) > 1 and w[-1:] in b",." and chr(w[-2]).isalpha() and w[-2] < 128]
        closed = set(ended)
        self._encode([w for w in dict.fromkeys([*(w for w in new if w not in closed), *(w[:-1] for w in ended), b",", b"."]) if w not in cache])
        for w in ended:  # punctuation after a letter is a token of its own
            cache[w] = cache[w[:-1]] + cache[w[-1:]]
        out = [b"".join(map(cache.__getitem__, p)) for p in parts]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class BestFit:
    """Best-fit windows: a segment tree over remaining capacities, each with a stack of open windows."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def _set(self, room: int, there: bool) -> None:
        tree = self.tree
        i = self.size + room
        while i and tree[i] != there:
            tree[i] = there
            i >>= 1
            there = tree[2 * i] or tree[2 * i + 1] if i else False

    def _tightest(self, need: int) -> int:
        """The least capacity of ``need`` or more that an open window has, or -1."""
        tree = self.tree
        i = self.size + need
        if tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def put(self, need: int) -> tuple[int, int]:
        """(window, offset in it) for a piece of ``need`` tokens."""
        room = self._tightest(need)
        if room < 0:
            window, room = self.windows, self.capacity
            self.windows += 1
        else:
            window = self.open[room].pop()
            if not self.open[room]:
                self._set(room, False)
        left = room - need
        if left:
            self.open[left].append(window)
            if len(self.open[left]) == 1:
                self._set(left, True)
        return window, self.capacity - room


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows of a document and what remains, with the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                ids, texts = (c.to_pylist() for c in b.slice(i, 256).columns)
                rows = []
                for doc_id, data in zip(ids, enc.batch(texts), strict=True):
                    data += end
                    n, salt = len(data) // 4, zlib.crc32(data)
                    for s in range(0, n, window):
                        part = data[4 * s : 4 * (s + window)]
                        rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), n, salt))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null or empty text: the document is its end id alone. Null doc_id: packed, with a null id. Repeated rows
    are packed each. Very long texts: cut into full windows. An empty table gives an empty result. Other columns
    are not read. Equal lengths are taken in the order of doc_id, then start, so the result is repeatable.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    pieces = tokenize(docs, tokenizer_path, end_id, window)
    # copies have equal ids and tokens: the row's own id spreads them
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "salt", "start"), F.lit(shards))).drop("salt")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins = BestFit(window)
        at = np.array([bins.put(n) for n in t["length"].to_pylist()], dtype=np.int64)
        base = t["shard"][0].as_py() << 32
        return t.drop_columns("shard").append_column("sequence_id", pa.array(base + at[:, 0])).append_column("offset", pa.array(at[:, 1]))

    return pieces.groupBy("shard").applyInArrow(fit, PACKED)

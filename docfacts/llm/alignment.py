"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Method: the ends of each tokenizer's tokens are a packed bitset over the bytes of a batch of texts. Their AND holds the cuts that
both share; the rank of a cut in a bitset, by population counts of words, is the number of tokens before it, so two cuts give a
group's token ranges. Links are all pairs of a group's ranges; equal pairs of a document are one row with a number.

Documents are dealt into shards of a bounded number of pairs where they are encoded. A shard's distinct pairs are counted there, so
a pair that every document holds is one row for a shard, and only these rows are shuffled: to sum a pair's documents, and to
bring the sums back to their shards.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch
from .bpe_automaton import CACHE_BYTES, ENTRY, Encoder, encoder

#: Texts and bytes that one step takes together; a longer text is a step of its own.
BATCH_TEXTS = 64
BATCH_BYTES = 4_000_000
#: Distinct pairs of documents and documents after which a shard ends.
SHARD_PAIRS = 200_000
SHARD_DOCS = 1_000
#: Links of a group from which its equal ids are counted before they are paired.
WIDE = 4096

LINKED = "shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>, shard_pairs array<bigint>, shard_docs array<bigint>"
NAMES = [c.split()[0] for c in LINKED.split(", ")]
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Ends:
    """A packed bitset of token ends over bytes, with ranks by population counts of its 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, ends: np.ndarray, size: int) -> Ends:
        """``ends``: offsets after the last bytes of tokens, ascending; ``size``: number of bytes."""
        bits = np.zeros(-(-max(size, 1) // 64) * 64, dtype=np.uint8)
        bits[ends - 1] = 1
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def __and__(self, other: Ends) -> Ends:
        return Ends(self.words & other.words)

    def select(self) -> np.ndarray:
        """Offsets after all set bits, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) + 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits below each offset."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... (n[i] of them), one after the other."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(before - starts, n)


class Pieces:
    """Ids of a SentencePiece model and the bytes of its pieces.

    Where no piece goes on after a word into the next one's mark, the words of a text are encoded on their own and kept.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.labels = np.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], dtype=object)
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.cache: dict[str, bytes | None] = {}
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes | None]:
        """Ids as bytes; None where their labels don't join to a space and the text."""
        made = self.model.encode(texts, num_threads=1)
        return [array("I", ids).tobytes() if b"".join(self.labels[ids].tolist()) == (" " + t).encode() else None for t, ids in zip(texts, made, strict=True)]

    def encode(self, text: str) -> bytes | None:
        """Ids of a text as bytes of uint32, or None where their labels don't join to a space and the text."""
        words = text.split(" ") if self.by_word and text[0] != " " and "  " not in text and text[-1] != " " else None
        if words is None:
            return self._whole([text])[0]
        cache = self.cache
        try:
            made = list(map(cache.__getitem__, words))
        except KeyError:
            if self.held > CACHE_BYTES:
                cache.clear()
                self.held = 0
            new = [w for w in dict.fromkeys(words) if w not in cache]
            for w, ids in zip(new, self._whole(new), strict=True):
                cache[w] = ids
                self.held += ENTRY + len(w) + len(ids or b"")
            made = list(map(cache.__getitem__, words))
        return None if None in made else b"".join(made)


class Aligner:
    """Groups and links of batches of texts between a byte-level BPE file (A) and a SentencePiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a: Encoder = encoder(path_a, special=False)
        self.b = Pieces(path_b)
        self.size = [np.array([len(x) for x in labels], dtype=np.int64) for labels in (self.a.label_of, self.b.labels)]
        self.n_b = len(self.b.labels)
        self.digits = [np.array([b"%d%s" % (i, mark) for i in range(max(map(len, self.size))) for mark in (b",", b"|", b";")], dtype=object)]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none where the labels of either don't join to a space and the text."""
        a = b = [np.zeros(0, dtype=np.uint32)] * len(texts)
        a, b = a.copy(), b.copy()
        for i, t in enumerate(texts):
            data = self.b.encode(t) if t else None
            if data:
                made = self.a.encode(" " + t)
                if self.a.emit(made) == (" " + t).encode():
                    a[i], b[i] = made, np.frombuffer(data, dtype=np.uint32)
        return a, b

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text: tokens of A and B, groups, links, digest of the groups, distinct pairs a * |B| + b and their numbers."""
        tokens = self.tokens(texts)
        ids = [np.concatenate(t).astype(np.int64) for t in tokens]
        of = [np.cumsum([0, *map(len, t)]) for t in tokens]
        out = [np.cumsum(size[x]) for size, x in zip(self.size, ids, strict=True)]
        ends = [Ends.of(x, int(x[-1]) if len(x) else 0) for x in out]
        cuts = (ends[0] & ends[1]).select()
        upto = [e.rank(cuts) for e in ends]  # tokens that end at a cut or before it
        first = [np.concatenate([[0], x[:-1]]) if len(x) else x for x in upto]
        n = [u - f for u, f in zip(upto, first, strict=True)]
        groups = np.searchsorted(upto[0], of[0], side="right")  # of the first group of each text
        links = n[0] * n[1]
        linked = np.concatenate([[0], np.cumsum(links)])
        text, pair, times = self._pairs(ids, first, n, links, groups)
        ends_of = np.searchsorted(text, np.arange(len(texts) + 1))
        said = self._said(ids, first, n)
        at = of[0] + of[1]
        done = []
        for i in range(len(texts)):
            g, h = groups[i], groups[i + 1]
            digest = hashlib.sha256(b"".join(said[at[i] : at[i + 1]])[:-1]).hexdigest() if h > g else ""
            k, m = ends_of[i], ends_of[i + 1]
            done.append((len(tokens[0][i]), len(tokens[1][i]), int(h - g), int(linked[h] - linked[g]), digest, pair[k:m], times[k:m]))
        return done

    def _said(self, ids: list[np.ndarray], first: list[np.ndarray], n: list[np.ndarray]) -> list[bytes]:
        """Decimal ids in the order of groups, A before B, each with the mark that follows it."""
        total = int(n[0].sum() + n[1].sum())
        key = np.zeros(total, dtype=np.int64)
        base = np.cumsum(n[0] + n[1]) - n[0] - n[1]
        for k, start, mark in ((0, base, 1), (1, base + n[0], 2)):
            key[ranges(start, n[k])] = 3 * ids[k]
            key[start + n[k] - 1] += mark
        return self.digits[0][key].tolist()

    def _pairs(self, ids: list[np.ndarray], first: list[np.ndarray], n: list[np.ndarray], links: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, number of links) of all distinct pairs, by text and pair."""
        text = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
        small = np.flatnonzero(links < WIDE)
        per_a = np.repeat(n[1][small], n[0][small])
        a = np.repeat(ids[0][ranges(first[0][small], n[0][small])], per_a)
        b = ids[1][ranges(np.repeat(first[1][small], n[0][small]), per_a)]
        # a key is a text and a pair; a vocabulary has at most 2 ** 20 ids
        key, times = np.unique(np.repeat(text[small], links[small]) << 40 | (a * self.n_b + b), return_counts=True)
        keys, numbers = [key], [times]
        for g in np.flatnonzero(links >= WIDE).tolist():
            (x, nx), (y, ny) = (np.unique(ids[k][first[k][g] : first[k][g] + n[k][g]], return_counts=True) for k in (0, 1))
            keys.append(text[g] << 40 | (x[:, None] * self.n_b + y[None, :]).ravel())
            numbers.append((nx[:, None] * ny[None, :]).ravel())
        if len(keys) > 1:
            every = np.concatenate(numbers)
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.zeros(len(key), dtype=np.int64)
            np.add.at(times, at, every)
        return key >> 40, key & ((1 << 40) - 1), times


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document with its distinct linked pairs and their numbers, and a row for each shard with its pairs and their
    documents (``shard_pairs``, null on rows of documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, shard, held, seen = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0, []

        def rows(columns: list) -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int64())] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)

        def close() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(seen), return_counts=True)
            return rows([[shard], *[[None]] * 8, [pairs], [n]])

        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"]
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and len(part) < BATCH_TEXTS and (not part or size + len(part[-1] or "") < BATCH_BYTES):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                made = aligner.align(part)
                of = []
                for r in made:
                    of.append(shard)
                    seen.append(r[5])
                    held += len(r[5])
                    if held >= SHARD_PAIRS or len(seen) >= SHARD_DOCS:
                        yield close()
                        shard, held, seen = shard + 1, 0, []
                yield rows([of, ids[at : at + len(part)], *(list(c) for c in zip(*made, strict=True)), [None] * len(part), [None] * len(part)])
                at += len(part)
        if seen:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LINKED)


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A pair's count is the number of rows that hold it linked. ``n_best`` counts links whose pair has the highest count of all pairs
    with its A id, ties included; ``count_sum`` adds the counts over links. Null and empty texts, and those that either tokenizer
    does not give back byte for byte, have no tokens: zeros and an empty digest. Repeated rows are counted and returned each, a
    null doc_id stays null. Texts are read whole: equal ids of a wide group are counted before they are paired. An empty table
    gives an empty result. Other columns are not read.
    """
    scratch = Scratch(spark, "alignment")
    n_b = len(Pieces(path_b).labels)
    made = scratch.table(linked(docs, path_a, path_b))
    held = made.where(F.col("shard_pairs").isNotNull()).select("shard", F.explode(F.arrays_zip(F.col("shard_pairs").alias("pair"), F.col("shard_docs").alias("n"))).alias("r")).select("shard", "r.pair", "r.n")
    count = scratch.table(held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / n_b)))
    best = count.groupBy("a").agg(F.max("count").alias("best"))  # at most one row for each id of A
    known = count.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    back = held.select("shard", "pair").join(known, "pair").select(F.col("shard").alias("of_shard"), "pair", "count", "best")
    docs_of = made.where(F.col("shard_pairs").isNull()).drop("shard_pairs", "shard_docs")

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(pairs := right["pair"].to_numpy())
        pairs, counts, top = pairs[order], right["count"].to_numpy()[order], right["best"].to_numpy()[order]
        left = left.combine_chunks()
        n_best, total = [], []
        for p, t in zip(left["pairs"], left["times"], strict=True):
            times = t.values.to_numpy()
            at = np.searchsorted(pairs, p.values.to_numpy())
            n_best.append(int(times[top[at]].sum()))
            total.append(int((times * counts[at]).sum()))
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
        return out.select([c.split()[0] for c in DIGEST.split(", ")])

    return docs_of.groupBy("shard").cogroup(back.groupBy("of_shard")).applyInArrow(fill, DIGEST)

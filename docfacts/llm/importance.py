"""Importance resampling of documents towards the word distribution of a target set.

Method: external sort and count. Each task writes blocks of packed uint16 buckets, one for every feature in order of the text,
with each document's offset into them, and beside them the block's sorted and run-length encoded counts. Counts of all blocks
are summed by bucket; buckets are at most 65,536, so their gains fit in a driver and go to every task. The blocks are then
read again: gains are gathered by bucket and summed between offsets with ``np.add.reduceat``. Scores are put in a total order by
a range partition, never by one task.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

#: Runs of ASCII digits and lower-case letters and of all other characters from U+0080.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Features after which a block ends; the last document of a block is never cut.
BLOCK = 1_000_000
#: Entries of a Python worker's cache from words to buckets (about 130 bytes each); it is emptied when full.
CACHE_WORDS = 600_000

BLOCKS = "ids array<bigint>, words array<bigint>, offsets array<bigint>, stream binary, bucket array<int>, n array<bigint>"
WEIGHED = "doc_id long, n_features long, weight long, score long, eligible boolean"


class Features:
    """Buckets of a text's features: all runs of 1 to ``runs`` words, joined by one space."""

    def __init__(self, buckets: int, runs: int):
        if not 1 <= buckets <= 1 << 16:
            raise ValueError("a bucket must fit in 16 bits")
        self.buckets, self.runs = buckets, runs
        self.cache: dict[str, int] = {}

    def bucket(self, feature: str) -> int:
        return zlib.crc32(feature.encode("utf-8", "replace")) % self.buckets

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, buckets of the features as uint16); shorter runs come first."""
        words = WORDS.findall(text.translate(LOWER)) if text else []
        cache, out = self.cache, []
        for k in range(1, min(self.runs, len(words)) + 1):
            if k == 1:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                for w in words:
                    b = cache.get(w)
                    if b is None:
                        b = cache[w] = self.bucket(w)
                    out.append(b)
            else:
                out += [self.bucket(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
        return len(words), np.array(out, dtype=np.uint16)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a stream in order, each with the length of its run in the sorted stream."""
    ordered = np.sort(stream)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), dtype=bool), ordered[1:] != ordered[:-1]]))
    return ordered[at], np.diff(np.append(at, len(ordered)))


def blocks(rows: DataFrame, buckets: int, runs: int, id_column: str | None = "doc_id") -> DataFrame:
    """Packed streams of ``rows`` with a text: ids, words and first features of their documents, buckets, and counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, runs)
        ids, words, offsets, parts, total = [], [], [0], [], 0

        def block() -> pa.RecordBatch:
            stream = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)
            value, n = run_lengths(stream)
            columns = [pa.array([x], pa.list_(pa.int64())) for x in (ids, words, offsets)]
            columns += [pa.array([stream.astype("<u2").tobytes()], pa.binary()), pa.array([value.astype(np.int32)], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "words", "offsets", "stream", "bucket", "n"])

        for b in batches:
            for doc_id, text in zip(b["id"].to_pylist(), b["text"], strict=True):
                n, made = features.of(text.as_py())
                ids.append(doc_id)
                words.append(n)
                parts.append(made)
                total += len(made)
                offsets.append(total)
                if total >= BLOCK:
                    yield block()
                    ids, words, offsets, parts, total = [], [], [0], [], 0
        if ids:
            yield block()

    id_of = F.col(id_column) if id_column else F.lit(None)
    return rows.select(id_of.cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def counts(made: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket over all blocks: one row a bucket reaches the driver."""
    out = [0] * buckets
    by = made.select(F.explode(F.arrays_zip("bucket", "n")).alias("r")).groupBy(F.col("r.bucket").alias("bucket")).agg(F.sum("r.n").alias("n"))
    for r in by.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in the corpus, floored."""
    s_all, t_all, k = sum(corpus), sum(target), len(corpus)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    """Thousandths of a Gumbel variate that hangs on seed and doc_id only, floored; a null doc_id counts as an empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(made: DataFrame, gain: np.ndarray, seed: str, least_words: int) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of each document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, words, offsets = (b[c][i].values.to_numpy(zero_copy_only=False) if c != "ids" else b[c][i].as_py() for c in ("ids", "words", "offsets"))
                stream = np.frombuffer(b["stream"][i].as_buffer(), dtype="<u2")
                n = np.diff(offsets)
                weight = np.zeros(len(n), dtype=np.int64)
                some = n > 0
                if some.any():  # reduceat gives an element, not zero, where two offsets are equal
                    weight[some] = np.add.reduceat(gain[stream], offsets[:-1][some]) // n[some]
                score = weight + np.array([gumbel(seed, x) for x in ids], dtype=np.int64)
                columns = [pa.array(ids, pa.int64()), pa.array(n), pa.array(weight), pa.array(score), pa.array(words >= least_words)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "eligible"])

    return made.select("ids", "words", "offsets", "stream").mapInArrow(run, WEIGHED)


def ranked(weighed: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``weighed`` with the rank of the drawn documents, by a range partition and row numbers carried from partition to partition.

    Only one count for each partition reaches the driver.
    """
    n = weighed.where("eligible").count()
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = scratch.table(weighed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(k for _, k in sizes)]).tolist(), strict=False))
    starts = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)])
    rank = F.element_at(starts, (part + 1).cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.col("eligible") & (rank <= F.lit(percent * n // 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = 10_000, runs: int = 1, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn without replacement towards ``target``.

    Of the documents with at least ``least_words`` words, the ``percent`` of a hundred with the highest scores are drawn; ties go
    to the smaller doc_id. Null and empty texts have no features and weight 0, and are never drawn while ``least_words`` is above 0.
    Repeated rows are scored and ranked each; of rows that tie in all, either may come first. A null doc_id comes last in ties.
    Very long texts are read whole. An empty ``docs`` gives an empty result, an empty ``target`` equal target counts for all
    buckets. Other columns are not read, whatever their names.
    """
    scratch = Scratch(spark, "importance")
    made = scratch.table(blocks(docs, buckets, runs))
    aim = blocks(target, buckets, runs, None)
    gain = gains(counts(made, buckets), counts(aim, buckets))
    return ranked(weigh(made, gain, seed, least_words), scratch, percent)

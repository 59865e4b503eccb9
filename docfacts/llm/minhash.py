"""Near-duplicate documents by b-bit MinHash on word shingles, confirmed on full shingle sets.

Method. A document's shingles are hashed to 64 bits; for each of ``PERMUTATIONS`` hash functions the least
value over its set is its minimum. Runs of ``BAND_ROWS`` minima make a band key; documents that share a key are
candidates. Of each minimum only ``BITS`` low bits are kept, packed; the share of equal fields, corrected for
chance collisions, estimates the similarity of candidates, and those far below the threshold are dropped.

Documents with equal sets are one class from the start (a map-side combined minimum), so groups of exact copies cost
nothing later. A band's candidates are not expanded into pairs: a spanning forest of those whose estimate is high enough
is all that leaves it. Its components, families of loosely similar documents, are then compared exactly on full sets, in
blocks, and again only a spanning forest of the exact links is written. So no link between components is lost, and the
rows written grow with the documents, not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, components, groups, starts_of, unused

#: 25 bands of 5 minima: a pair with a similarity of 0.8 shares no band with a probability of 0.00005.
BANDS, BAND_ROWS, BITS = 25, 5, 4
PERMUTATIONS = 128
#: Estimates below the threshold by this much or more are dropped (over four standard errors of the estimate).
MARGIN = 0.16
#: A band's members, and those of a family, are compared in blocks of about this many, or of so many shingles.
BLOCK, FAMILY, SHINGLES = 2048, 512, 1_000_000
CACHE_WORDS = 250_000

_M = np.uint64
_A = np.random.default_rng(11).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * _M(2) + _M(1)
_B = np.random.default_rng(12).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_C1, _C2 = _M(0x9E3779B97F4A7C15), _M(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _M(31))) * _M(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _M(27))) * _M(0x94D049BB133111EB)
    return h ^ (h >> _M(31))


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; fewer words make one shingle, none make none.

    Words are runs of characters other than space and U+0009 to U+000D; A-Z are lower-cased.
    Unequal shingles of a text share a hash with a probability below 2^-40.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    if n < 1:
        n, k = 1, len(h)
    out = h[:n].copy()
    for i in range(1, k):
        out = _mix(out * _C1 + _M(i)) + h[i : i + n] * _C2
    out = _mix(out + _M(k))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _C1
    rows = low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    for i in range(BAND_ROWS):
        key = _mix(key + rows[:, i] * _C2)
    return key.view(np.int64)


def pack_bits(low: np.ndarray) -> bytes:
    """``BITS`` bits of each minimum, sixteen to a 64-bit number."""
    bits = (_mix(low) & _M(2**BITS - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(bits << (np.arange(64 // BITS, dtype=np.uint64) * _M(BITS)), axis=1).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis) by counts of equal fields, corrected for collisions by chance."""
    x = a ^ b
    x = (x | x >> _M(1) | x >> _M(2) | x >> _M(3)) & _M(0x1111111111111111)
    same = 1 - np.bitwise_count(x).sum(axis=-1) / PERMUTATIONS
    return (same - 2.0**-BITS) / (1 - 2.0**-BITS)


SKETCH = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, sig binary"


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """One row per document: size and 128-bit digest of its shingle set, band keys, packed signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, texts = b.slice(at, 512).columns
                n, hi, lo, bands, sigs = [], [], [], [], []
                for t in texts.to_pylist():
                    s = shingle_set(t, k)
                    n.append(len(s))
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    hi.append((d >> 64) - 2**63)
                    lo.append((d & 2**64 - 1) - 2**63)
                    low = minima(s) if len(s) else None
                    bands.append(band_keys(low) if len(s) else None)
                    sigs.append(pack_bits(low) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "bands", "sig"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def _forest(linked, n: int) -> list[tuple[int, int]]:
    """Links (earlier, later) of a spanning forest of n rows; ``linked(i, rest)`` says which of ``rest`` row i links to."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            found = rest[hit]
            rest = rest[~hit]
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _loose(threshold: float):
    """Spanning forests (a, b) of a band's members by estimated similarity; rows come by (key, block) with id and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "key", "block"):
            ids = t["id"].to_numpy()
            sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            at = starts_of(t, "key", "block")
            two = np.array([s for s, e in at if e - s == 2], dtype=np.int64)
            two = two[estimate(sigs[two], sigs[two + 1]) >= threshold] if len(two) else two
            out = set(zip(ids[two].tolist(), ids[two + 1].tolist(), strict=True))
            for s, e in at:
                if e - s > 2:
                    own, mine = sigs[s:e], ids[s:e].tolist()
                    out.update((mine[i], mine[j]) for i, j in _forest(lambda i, rest, own=own: estimate(own[rest], own[i]) >= threshold, e - s))
            yield _pairs_batch([p for p in out if p[0] != p[1]])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all two sets, by products of their incidence over shared hashes."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # hashes of one set only meet nothing
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[s:e], column[s:e] - k * width] = 1
        out += part @ part.T
    return out


def _exact(k: int, num: int, den: int):
    """Spanning forests (a, b) of exact links of families; rows come by (comp, block) with id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "comp", "block"):
            out = []
            for s, e in starts_of(t, "comp", "block"):
                part = t.slice(s, e - s)
                ids, sets = part["id"].to_pylist(), [shingle_set(x, k) for x in part["text"].to_pylist()]
                size = np.array([len(x) for x in sets], dtype=float)
                both = intersections(sets)
                hit = (den * both >= num * (size[:, None] + size[None, :] - both)) & (both > 0)
                out += [(ids[i], ids[j]) for i, j in _forest(lambda i, rest, hit=hit: hit[i, rest], e - s) if ids[i] != ids[j]]
            yield _pairs_batch(out)

    return run


def _blocks(rows: DataFrame, parts: Column) -> DataFrame:
    """``rows`` with ``block``: a group is cut into ``parts`` parts by a hash of id, and every two parts meet in a block.

    A group of one part is one block; others are repeated once for each part.
    """
    rows = rows.withColumn("parts", F.greatest(parts, F.lit(1)).cast("long")).withColumn("side", F.pmod(F.xxhash64("id", F.lit(5)), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    block = F.least("side", "other") * F.col("parts") + F.greatest("side", "other")
    return rows.withColumn("other", other).withColumn("block", block).drop("parts", "side", "other")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of k-word shingles. component_id is
    the smallest doc_id that can be reached, kept is doc_id = component_id. Null or empty texts have an empty set and link
    with nothing. A null doc_id has a null component and is kept. Rows that share a doc_id are each returned; they count
    as one document, so their texts' links are joined. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(spark, "minhash")
    rows = scratch.table(sketch(docs, k))
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets: one class, named by its smallest id
    classes = some.groupBy("hi", "lo").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "bands", "sig", F.col("n_shingles").alias("size")), "doc_id").alias("m"))
    members = scratch.table(classes.select("hi", "lo", "m.*"))
    bands = members.select("id", F.explode("bands").alias("key"))
    keys = scratch.table(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = scratch.table(bands.join(keys, "key"))

    # families: components of band neighbours whose estimate is near the threshold or above
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = _blocks(shared, F.ceil(F.col("n") / BLOCK)).join(members.select("id", "sig"), "id").select("key", "block", "id", "sig")
    near = near.repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    loose = components(near.mapInArrow(_loose(num / den - MARGIN), "a long, b long"), scratch)
    scratch.drop(shared)
    family = scratch.table(loose.unionByName(loose.select(F.col("component").alias("id"), "component").distinct()))
    weighed = family.join(members.select("id", "size"), "id")
    sizes = scratch.table(weighed.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")))

    # exact links within each family, on the full sets of its texts; long texts make more and smaller parts
    parts_of = F.greatest(F.ceil(F.col("n") / FAMILY), F.least("n", F.ceil(F.col("shingles") / SHINGLES)))
    own = _blocks(family.join(sizes, "component").withColumnRenamed("component", "comp"), parts_of).select("comp", "block", "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # families grow with the documents: a shuffled join at every size
    own = texts.join(own.hint("merge"), "id").repartition(parts, "comp", "block").sortWithinPartitions("comp", "block")
    links = own.select("comp", "block", "id", "text").mapInArrow(_exact(k, num, den), "a long, b long")
    final = components(links, scratch)

    named = members.join(final, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, ["hi", "lo"], "left")
    comp = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each component; of each doc_id that stays its least row.

    Rows with a null doc_id all stay. Columns are those of ``docs``.
    """
    found = Scratch(spark, "kept").table(near_duplicates(spark, docs, k, num, den).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")))
    dropped = unused("gone", docs.columns)
    gone = found.where("NOT kept").select(F.col("doc_id").alias(dropped))
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(dropped), "left_anti")
    if found.where("n > 1").isEmpty():
        return left
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    least = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*")
    return least.select(*[f"`{c}`" for c in docs.columns]).unionByName(left.where("doc_id IS NULL"))

"""Near-duplicate embeddings by sorted projection passes.

Method. In each pass every vector gets a key of concatenated random hashes: signs of random projections of what is left of it
after the centre of its label is taken away, since embeddings tend to share a direction. Vectors are ordered by label and key
over the whole cluster, and each is compared in double precision with the next ``WINDOW`` vectors of that order. Links
found are united across passes.

The number of passes is measured, not assumed: on a bounded sample of each large label ``passes_for`` finds how many hashes
thin out a vector's unlinked neighbours to half a window, and how likely a pair at the threshold agrees on so many. Only a label
for which that would take more passes than it has rows is one window: all its vectors are compared in blocks. Callers can ask
for the same where passes cost more than a stated share of that (``whole``).

Equal vectors of a label are one class from the start. Windows only have to connect a component: all links
within each component are then counted exactly, in blocks, so large groups of near copies are whole although
windows are bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, components, groups, starts_of

WINDOW, BITS = 32, 48
#: Rows of the order that one step compares, and rows of a component and of a label that are compared at once.
BLOCK, DENSE, DENSE_LABEL, CHUNK = 2048, 512, 2048, 256
#: Share of the pairs at the threshold that passes may miss.
MISS = 0.0001
#: The largest labels are measured one by one, by a sample of so many rows each; others by what is worst among these.
LABELS, SAMPLE = 32, 512


def passes_for(y: np.ndarray, centre: np.ndarray, rows: int, cosine: float) -> float:
    """Passes after which ``MISS`` of the pairs at the threshold are still missed, among ``rows`` vectors like the unit rows ``y``.

    For each sampled vector: the number of leading hashes on which less than half a window of unlinked vectors agree with
    it, and the probability that a vector at the threshold does. Infinite if it would take more than ``rows`` passes.
    """
    if rows <= WINDOW + 1:
        return 1.0
    u = y - centre
    size = np.maximum(np.linalg.norm(u, axis=1), 1e-12)
    agree = 1 - np.arccos(np.clip(1 - (1 - cosine) / size**2, -1, 1)) / np.pi
    angle = np.arccos(np.clip((u / size[:, None]) @ (u / size[:, None]).T, -1, 1))
    # linked neighbours do not crowd a window: they connect what they meet
    same = np.where(y @ y.T < cosine, 1 - angle / np.pi, 0.0)
    once = np.zeros(len(y))
    crowd, left = np.full(len(y), float(rows)), np.ones(len(y), dtype=bool)
    power = (same > 0).astype(float)
    for bits in range(1, BITS + 1):
        power *= same
        crowd = rows * power.mean(axis=1)
        done = left & ((crowd <= WINDOW / 2) | (bits == BITS))
        once[done] = agree[done] ** bits * np.minimum(1, WINDOW / 2 / np.maximum(crowd[done], 1e-9))
        left &= ~done
        if not left.any():
            break
    passes = 1
    while np.mean((1 - once) ** passes) > MISS:
        if passes > rows:
            return float("inf")
        passes += max(1, passes // 16)
    return float(passes)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64, copy=False)


def unit(x: np.ndarray) -> np.ndarray:
    # by the greatest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(column: str = "embedding"):
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))


class Plan:
    """How each label is treated: its centre and passes (0: it is compared whole); ``rest`` stands for labels not measured."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.own: dict[tuple[int, int], tuple[np.ndarray | None, int]] = {}
        self.rest = 1

    @staticmethod
    def choose(passes: float, rows: int, whole: float | None) -> int:
        return 0 if passes == float("inf") or (whole is not None and passes * WINDOW > whole * rows) else int(passes)

    @classmethod
    def measure(cls, classes: DataFrame, cosine: float, passes: int | None = None, whole: float | None = None) -> Plan:
        """From classes (id, label, dims, embedding); ``passes`` overrides what is measured, ``whole`` see the module."""
        plan = cls(cosine)
        sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dims").limit(LABELS + 1).collect()
        large, rest = sizes[:LABELS], sizes[LABELS:]
        wanted = classes.sparkSession.createDataFrame([(r["label"], r["dims"]) for r in large], "label long, dims int")
        order = Window.partitionBy("label", "dims").orderBy(F.xxhash64("id", F.lit(3)))
        some = classes.join(F.broadcast(wanted), ["label", "dims"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)
        rows: dict[tuple[int, int], list] = {}
        for r in some.select("label", "dims", "embedding").collect():  # LABELS * SAMPLE rows at most
            rows.setdefault((r["label"], r["dims"]), []).append(r["embedding"])
        worst = 1.0
        for r in large:
            y = unit(np.array(rows[r["label"], r["dims"]], dtype=float))
            centre = y.mean(axis=0)
            need = float(passes) if passes else passes_for(y, centre, r["n"], cosine)
            plan.own[r["label"], r["dims"]] = (centre, int(passes) if passes else cls.choose(need, r["n"], whole))
            if rest:
                worst = max(worst, float(passes) if passes else passes_for(y, np.zeros(r["dims"]), rest[0]["n"], cosine))
        if rest:
            plan.rest = passes or cls.choose(worst, rest[0]["n"], whole)
        return plan

    def of(self, label: int, dims: int) -> tuple[np.ndarray | None, int]:
        return self.own.get((label, dims), (None, self.rest))


def _keys(classes: DataFrame, plan: Plan) -> DataFrame:
    """(pass, label, dims, key, id): one row for each class and pass of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for b in batches:
            dims, labels = b.column("dims").to_numpy(), b.column("label").to_numpy()
            for d in np.unique(dims).tolist():
                known = [x for x, y in plan.own if y == d]
                own = [(dims == d) & (labels == x) for x in known]
                rest = (dims == d) & ~np.isin(labels, known)
                for pick, (centre, passes) in [*zip(own, (plan.of(x, d) for x in known), strict=True), (rest, (None, plan.rest))]:
                    if not passes or not pick.any():
                        continue
                    part = b.filter(pa.array(pick))
                    y = unit(_matrix(part.column("embedding")))
                    y = y if centre is None else y - centre
                    for n in range(passes):
                        # made anew for each batch: no worker holds the planes of all passes
                        keys = (y @ np.random.default_rng([d, n]).standard_normal((d, BITS)) > 0) @ weights
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), n, dtype=np.int32)), part.column("label"), part.column("dims"), pa.array(keys), part.column("id")], names=["pass", "label", "dims", "key", "id"])

    return classes.select("id", "label", "dims", "embedding").mapInArrow(run, "pass int, label long, dims int, key long, id long")


def _ranked(keys: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """Adds ``rank``, the place in the order of all rows, by a range shuffle and counts per partition."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + n))], names=[*b.schema.names, "idx"])
            at += n

    order = ["pass", "label", "dims", "key", "id"]
    sorted_rows = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch.table(sorted_rows.withColumn("pid", F.spark_partition_id()).mapInArrow(number, "pass int, label long, dims int, key long, id long, pid int, idx long"))
    counts = sorted(placed.groupBy("pid").agg(F.count("*").alias("n")).collect())  # a row for each partition
    base, rows = 0, []
    for pid, n in counts:
        rows.append((pid, base))
        base += n
    offsets = scratch.spark.createDataFrame(rows, "pid int, base long")
    return placed.join(F.broadcast(offsets), "pid").withColumn("rank", F.col("idx") + F.col("base")).drop("pid", "idx", "base")


def _roots(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of n rows is connected to by links (i, j)."""
    root, up = np.arange(n), list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in links:
        a, b = root[i], root[j]
        pairs = np.unique(np.minimum(a, b)[a != b] * n + np.maximum(a, b)[a != b])
        for p in pairs.tolist():
            x, y = find(p // n), find(p % n)
            up[max(x, y)] = min(x, y)
        if len(pairs):
            own = np.unique(root)
            root = np.array([find(x) for x in own.tolist()])[np.searchsorted(own, root)]
    return root


def _in_window(y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in range(0, len(y), WINDOW):
        i, j = np.nonzero(y[s : s + WINDOW] @ y[s : s + 2 * WINDOW].T >= cosine)
        near = (j > i) & (j - i <= WINDOW)
        yield i[near] + s, j[near] + s


def _in_block(y: np.ndarray, side: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each chunk of rows; a block of two sides links across them only."""
    across = (side != side[0]).any()
    for s in range(0, len(y), CHUNK):
        hit = y[s : s + CHUNK] @ y.T >= cosine
        if across:
            hit &= side[s : s + CHUNK, None] != side[None, :]
        i, j = np.nonzero(hit)
        i = i + s
        yield i[i != j], j[i != j]


def _batch(ids: list[np.ndarray], roots: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (roots, ids))
    return pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], names=["a", "b"])


def _windows(cosine: float):
    """(a, b) that connect what the windows of a block of the order link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "block"):
            found: tuple[list, list] = ([], [])
            for s, e in starts_of(t, "block"):
                part = t.slice(s, e - s)
                own = [part[c].to_numpy() for c in ("pass", "label", "dims")]
                cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1
                ids = part["id"].to_numpy()
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
                    if hi - lo > 1:
                        y = unit(_matrix(part["embedding"].slice(lo, hi - lo)))
                        found[0].append(ids[lo:hi])
                        found[1].append(ids[lo:hi][_roots(hi - lo, _in_window(y, cosine))])
            yield _batch(*found)

    return run


def _whole(cosine: float):
    """(a, b) that connect what is linked in each block, of rows in (comp, block) order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "comp", "block"):
            found: tuple[list, list] = ([], [])
            for s, e in starts_of(t, "comp", "block"):
                part = t.slice(s, e - s)
                ids = part["id"].to_numpy()
                found[0].append(ids)
                found[1].append(ids[_roots(e - s, _in_block(unit(_matrix(part["embedding"])), part["side"].to_numpy(), cosine))])
            yield _batch(*found)

    return run


def _counts(cosine: float):
    """(id, links) partial counts of links within a component, weighted by copies, of rows in (comp, block) order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "comp", "block"):
            ids, links = [], []
            for s, e in starts_of(t, "comp", "block"):
                part = t.slice(s, e - s)
                y, copies, side = unit(_matrix(part["embedding"])), part["copies"].to_numpy(), part["side"].to_numpy()
                n = np.zeros(e - s, dtype=np.int64)
                for i, j in _in_block(y, side, cosine):
                    n += np.bincount(i, weights=copies[j], minlength=e - s).astype(np.int64)
                ids.append(part["id"].to_numpy())
                links.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], names=["id", "links"])

    return run


def _blocked(rows: DataFrame, parts: int, dense: int) -> DataFrame:
    """Rows (comp, m, id, copies, embedding) of groups of m rows in blocks in which every two parts of a group meet once."""
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / dense).cast("long")).withColumn("side", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("block", F.least("side", "o") * F.col("blocks") + F.greatest("side", "o"))
    return rows.select("comp", "block", "id", "side", "copies", "embedding").repartition(parts, "comp", "block").sortWithinPartitions("comp", "block")


def embedding_near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.93, passes: int | None = None, whole: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and their cosine is ``cosine`` or more. Vectors that are
    null, empty, zero or hold null or non-finite components, and vectors of unequal length, link with nothing. A null vec_id
    links with nothing, has a null component and is kept. Rows that share a vec_id are each compared. An empty table gives
    an empty result. Other columns are not read. ``passes`` overrides the measured number of passes for all labels;
    ``whole`` has labels compared whole where passes would compare each row with more than so many times the label's rows.
    """
    scratch = Scratch(spark, "embeddings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # single precision travels as it is; all comparing is in double precision
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable()
    rows = rows.withColumn("hi", F.when(ok, F.xxhash64("label", "embedding"))).withColumn("lo", F.when(ok, F.xxhash64("embedding", F.lit(7))))
    classes = rows.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min_by(F.struct(F.col("vec_id").alias("id"), "label", "embedding"), "vec_id").alias("c"), F.count("*").alias("copies"))
    classes = scratch.table(classes.select("hi", "lo", "c.*", "copies").withColumn("dims", F.size("embedding")))
    plan = Plan.measure(classes, cosine, passes, whole)

    ranked = _ranked(_keys(classes, plan), scratch, parts)
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    # the first rows of a block also end the windows of the block before
    halo = F.when((F.col("rank") % BLOCK < WINDOW) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = ranked.withColumn("block", F.explode(halo)).join(classes.select("id", "embedding"), "id")
    dealt = dealt.repartition(parts, "block").sortWithinPartitions("block", "rank").select("block", "pass", "label", "dims", "id", "embedding")
    links = dealt.mapInArrow(_windows(cosine), "a long, b long")
    whole = [k for k, (_, p) in plan.own.items() if not p]
    if whole or not plan.rest:
        sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("m"))
        own = F.exists(F.array(*[F.struct(F.lit(a).cast("long").alias("label"), F.lit(b).alias("dims")) for a, b in whole]), lambda x: (x["label"] == F.col("label")) & (x["dims"] == F.col("dims"))) if whole else F.lit(False)
        if not plan.rest:
            measured = F.array(*[F.struct(F.lit(a).cast("long").alias("label"), F.lit(b).alias("dims")) for a, b in plan.own])
            own = own | ~F.exists(measured, lambda x: (x["label"] == F.col("label")) & (x["dims"] == F.col("dims")))
        all_of = classes.where(own).join(sizes, ["label", "dims"]).withColumn("comp", F.xxhash64("label", "dims"))
        links = links.unionByName(_blocked(all_of, parts, DENSE_LABEL).mapInArrow(_whole(cosine), "a long, b long"))
    found = components(links, scratch)

    # all links within each component
    every = scratch.table(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()))
    sizes = every.groupBy("component").agg(F.count("*").alias("m"))
    own = every.join(sizes, "component").join(classes.select("id", "embedding", "copies"), "id").withColumnRenamed("component", "comp")
    counted = _blocked(own, parts, DENSE).mapInArrow(_counts(cosine), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))

    known = classes.join(every, "id", "left").join(counted, "id", "left")
    known = scratch.table(known.select("hi", "lo", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    alone = rows.where("hi IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("hi IS NOT NULL").select("vec_id", "hi", "lo").join(known, ["hi", "lo"], "left").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

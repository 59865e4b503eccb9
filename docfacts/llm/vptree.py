"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Method. A top vantage-point tree over a bounded sample cuts space into at most ``LEAVES`` regions. Every vector falls into a
region, and a region is cut into shards of bounded size by a hash of ids. Each shard's distinct vectors become a
vantage-point tree, one row of an index table. A query first searches the region it is deepest in; its k-th score
then decides which other regions and which branches of their trees can still hold a nearer vector.

The bound is of the inner product itself: for vectors p within r of a centre c the triangle inequality gives
q.p <= q.c + |q| r; at a vantage point the gap between q and a branch's shell of distances gives a second one. ``relax`` scales
both: with 1 the search is exact, below 1 radii shrink and gaps widen, and it visits less. All bounds have a margin for
rounding, and what is within rounding of the k-th score is scored exactly and ordered by (score, vec_id).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch
from .embed_dedup import _matrix, usable

#: Rows that the top tree is grown on (those with the least hash of their id), and regions at most.
SAMPLE, LEAVES = 4096, 1024
#: Bytes of a shard's vectors and of a block of queries that meets it; rows of a tree's leaf.
SHARD_BYTES, QUERY_ROWS, LEAF = 8 << 20, 4096, 256
#: Found rows of a block of queries that are held before they are cut to each query's best.
HELD = 2_000_000
UNIT = float(np.finfo(np.float64).eps)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class VPTree:
    """Points in leaf order. A node is (vantage point, left, right), or (-1, first, end) for a leaf.

    ``shell`` holds for each node the least and the greatest distance of its points to its parent's vantage point, ``top``
    their greatest norm.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, shell: np.ndarray, top: np.ndarray):
        self.points, self.order, self.nodes, self.shell, self.top = points, order, nodes, shell, top
        self.visited = 0

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF, seed: int = 5) -> VPTree:
        rng = np.random.default_rng(seed)
        order, size = np.arange(len(points)), norms(points)
        nodes: list[list[int]] = []
        shell: list[tuple[float, float]] = []
        top: list[float] = []
        stack = [(0, len(points), -1, 0, (0.0, np.inf))] if len(points) else []
        while stack:
            lo, hi, parent, side, ring = stack.pop()
            me = len(nodes)
            nodes.append([-1, lo, hi])
            shell.append(ring)
            top.append(float(size[order[lo:hi]].max()))
            if parent >= 0:
                nodes[parent][side] = me
            if hi - lo > leaf:
                own = order[lo:hi]
                # of a few candidates the vantage point whose distances spread most
                tries = rng.choice(own, min(6, hi - lo), replace=False)
                probe = points[rng.choice(own, min(128, hi - lo), replace=False)]
                v = max(tries.tolist(), key=lambda t: float(norms(probe - points[t]).std()))
                d = norms(points[own] - points[v])
                half = (hi - lo) // 2
                part = np.argpartition(d, half)
                order[lo:hi], d = own[part], d[part]
                nodes[me] = [v, 0, 0]
                stack.append((lo, lo + half, me, 1, (float(d[:half].min()), float(d[:half].max()))))
                stack.append((lo + half, hi, me, 2, (float(d[half:].min()), float(d[half:].max()))))
        return cls(points, order, np.array(nodes, dtype=np.int64).reshape(-1, 3), np.array(shell).reshape(-1, 2), np.array(top))

    def save(self) -> dict[str, np.ndarray]:
        return {"points": self.points, "order": self.order, "nodes": self.nodes, "shell": self.shell, "top": self.top}

    def bound(self, node: int, qv: np.ndarray, dq: np.ndarray, q: np.ndarray, v: float, relax: float) -> np.ndarray:
        """The most that an inner product of the queries with a point of ``node`` can be.

        ``qv`` and ``dq`` are inner products with and distances to the parent's vantage point of norm ``v``, ``q`` norms.
        """
        (low, high), top = self.shell[node].tolist(), float(self.top[node])
        slack = (self.points.shape[1] + 8) * UNIT
        ball = qv + relax * q * high + slack * q * (v + high + top)
        gap = np.maximum(np.maximum(low - dq, dq - high), 0) / relax
        ring = (q * q + top * top - gap * gap) / 2 + slack * (q * q + top * top + (dq + high) ** 2)
        return np.fmin(np.fmin(ball, ring), q * top * (1 + slack))

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None, relax: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) of all points that may be among the k + 1 nearest distinct ones of a query or tie with them.

        ``floor`` holds scores below which points do not matter.
        """
        if not len(self.nodes) or not len(queries):
            return
        q, slack = norms(queries), (self.points.shape[1] + 8) * UNIT
        low = np.full(len(queries), -np.inf) if floor is None else floor - slack * np.abs(floor)
        best = np.full((len(queries), k + 1), -np.inf)
        stack = [(0, np.arange(len(queries)), np.full(len(queries), np.inf))]
        while stack:
            node, who, most = stack.pop()
            who = who[~(most < low[who])]
            if not len(who):
                continue
            v, a, b = self.nodes[node].tolist()
            if v < 0:
                own = self.order[a:b]
                self.visited += len(who) * len(own)
                s = queries[who] @ self.points[own].T
                both = np.hstack([best[who], s])
                best[who] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                margin = slack * q[who] * self.top[node]
                low[who] = np.maximum(low[who], best[who].min(axis=1) - 2 * margin)
                i, j = np.nonzero(s >= (low[who] - margin)[:, None])
                yield who[i], own[j]
                continue
            at = self.points[v]
            qv, dq, vn = queries[who] @ at, norms(queries[who] - at), float(np.sqrt(at @ at))
            bounds = [(n, self.bound(n, qv, dq, q[who], vn, relax)) for n in (a, b)]
            # the branch that is nearer for most queries comes first
            bounds.sort(key=lambda x: float(np.mean(x[1])))
            stack += [(n, who, x) for n, x in bounds]


def region_of(tree: VPTree | None, x: np.ndarray) -> np.ndarray:
    """The leaf node of the top tree that each vector falls into; 0 without a tree."""
    out = np.zeros(len(x), dtype=np.int64)
    if tree is None:
        return out
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, who = stack.pop()
        v, a, b = tree.nodes[node].tolist()
        if v < 0 or not len(who):
            out[who] = node
            continue
        inside = norms(x[who] - tree.points[v]) <= tree.shell[a][1]
        stack += [(a, who[inside]), (b, who[~inside])]
    return out


class Regions:
    """Top trees by length of vector, each region's centre, and what is known of its rows: count, radius and greatest norm."""

    def __init__(self, trees: dict[int, VPTree]):
        self.trees = trees
        self.centre: dict[tuple[int, int], np.ndarray] = {}
        for dims, t in trees.items():
            for n in np.flatnonzero(t.nodes[:, 0] < 0).tolist():
                own = t.points[t.order[t.nodes[n, 1] : t.nodes[n, 2]]]
                self.centre[dims, n] = own.mean(axis=0)
        self.facts: dict[int, list[tuple[int, np.ndarray, float, float]]] = {}

    def centre_of(self, dims: int, region: int) -> np.ndarray:
        return self.centre.get((dims, region), np.zeros(dims))

    def learn(self, rows: list) -> None:
        for r in rows:
            self.facts.setdefault(r["dims"], []).append((r["region"], self.centre_of(r["dims"], r["region"]), r["radius"], r["top"]))

    def bounds(self, dims: int, x: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(regions, bounds): the most that an inner product of each query with a row of each region can be."""
        own = self.facts.get(dims, [])
        ids, c = np.array([f[0] for f in own]), np.array([f[1] for f in own]).reshape(len(own), dims)
        radius, top = (np.array([f[i] for f in own]) for i in (2, 3))
        q, slack = norms(x)[:, None], (dims + 8) * UNIT
        return ids, np.fmin(x @ c.T + relax * q * radius, q * top) + slack * q * (norms(c) + radius + top)


def _grow(sample: list[tuple[int, np.ndarray]], count: int, shard_bytes: int) -> Regions:
    trees = {}
    for dims in {d for d, _ in sample}:
        own = np.array([x for d, x in sample if d == dims])
        wanted = max(1, min(LEAVES, -(-count * len(own) // len(sample) * dims * 8 // shard_bytes)))
        if wanted > 1 and len(own) > 1:
            trees[dims] = VPTree.build(own, leaf=max(1, -(-len(own) // wanted)))
    return Regions(trees)


PLACED = "vec_id long, dims int, embedding array<double>, is_query boolean, region long, away double, size double"


def _place(rows: DataFrame, regions: Regions) -> DataFrame:
    """Adds each vector's region, its distance to the region's centre and its norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = _matrix(part.column("embedding"))
                at = region_of(regions.trees.get(d), x)
                away = np.empty(len(x))
                for r in np.unique(at).tolist():
                    away[at == r] = norms(x[at == r] - regions.centre_of(d, r))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at), pa.array(away * (1 + 8 * UNIT)), pa.array(norms(x) * (1 + 8 * UNIT))], names=[*part.schema.names, "region", "away", "size"])

    return rows.select("vec_id", "dims", "embedding", "is_query").mapInArrow(run, PLACED)


def _build(k: int):
    """A shard's tree over its distinct vectors with the k + 1 least ids of each: further copies cannot be among a query's k nearest."""

    def build(t: pa.Table) -> pa.Table:
        x, inverse = np.unique(_matrix(t["embedding"]), axis=0, return_inverse=True)
        ids, of = t["vec_id"].to_numpy(), inverse.ravel()
        by = np.lexsort((ids, of))
        first = np.searchsorted(of[by], np.arange(len(x) + 1))
        by = by[np.arange(len(by)) - first[of[by]] <= k]
        out = io.BytesIO()
        np.savez(out, **VPTree.build(x).save(), ids=ids[by], of=of[by])
        return pa.table({c: t[c][:1] for c in ("dims", "region", "sub")} | {"tree": pa.array([out.getvalue()], pa.binary())})

    return build


def _best(qid: np.ndarray, q: np.ndarray, tree: VPTree, ids: np.ndarray, first: np.ndarray, pairs: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score): each query's k rows of largest exact score, ties to smaller ids, among (query, point) pairs or such triples."""
    who, vec, score = [], [], []
    for p in pairs:
        if len(p) == 3:
            w, v, s = p
        else:
            w, point = p
            s = np.empty(len(w))
            for i in range(0, len(w), 65536):
                s[i : i + 65536] = (tree.points[point[i : i + 65536]] * q[w[i : i + 65536]]).sum(axis=1)
            n = first[point + 1] - first[point]
            w, s = np.repeat(w, n), np.repeat(s, n)
            v = ids[np.repeat(first[point] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        own = v != qid[w]
        who.append(w[own]), vec.append(v[own]), score.append(s[own])
    w, v, s = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((who, np.int64), (vec, np.int64), (score, float)))
    by = np.lexsort((v, -s, w))
    w, v, s = w[by], v[by], s[by]
    nth = np.arange(len(w)) - np.searchsorted(w, w)
    return w[nth < k], v[nth < k], s[nth < k]


FOUND = "query_id long, vec_id long, score double"


def _search(k: int, relax: float):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        qid, vec, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(index) and len(queries):
            z = np.load(io.BytesIO(index["tree"][0].as_py()))
            tree, ids = VPTree(z["points"], z["order"], z["nodes"], z["shell"], z["top"]), z["ids"]
            first = np.searchsorted(z["of"], np.arange(len(tree.points) + 1))
            qid, q = queries["vec_id"].to_numpy(), _matrix(queries["embedding"])
            floor = queries["floor"].to_numpy()
            pairs, held = [], 0
            for w, p in tree.search(q, k, floor, relax):
                pairs.append((w, p))
                held += len(w)
                if held > HELD:
                    pairs = [_best(qid, q, tree, ids, first, pairs, k)]
                    held = len(pairs[0][0])
            w, vec, score = _best(qid, q, tree, ids, first, pairs, k)
            qid = qid[w]
        return pa.table({"query_id": pa.array(qid, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, relax: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query, the k other rows with the largest inner product.

    Ties go to the smaller vec_id; all other rows are returned if they are fewer than k. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows with a null vec_id, take no part; vectors of unequal length are not
    compared. Rows that share a vec_id are candidates each, and one query (that of the least vector). An empty table gives an
    empty result. Other columns are not read. ``relax`` is above 0 and at most 1 (exact).
    """
    if not 0 < relax <= 1:
        raise ValueError("relax must be above 0 and at most 1")
    scratch = Scratch(spark, "vptree")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where("vec_id IS NOT NULL").where(usable()).withColumn("dims", F.size("embedding"))
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(SAMPLE).select("dims", "embedding").collect()
    regions = _grow([(r["dims"], np.array(r["embedding"])) for r in sample], count, SHARD_BYTES)
    placed = scratch.table(_place(rows, regions))
    # a row for each region: LEAVES for each length of vector in the sample, one for any other length
    facts = placed.groupBy("dims", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("size").alias("top")).collect()
    regions.learn(facts)
    subs = [(r["dims"], r["region"], max(1, -(-r["n"] * r["dims"] * 8 // SHARD_BYTES))) for r in facts]
    shards = F.broadcast(spark.createDataFrame(subs, "dims int, region long, subs long"))
    dealt = placed.join(shards, ["dims", "region"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), "subs"))
    index = scratch.table(dealt.select("dims", "region", "sub", "vec_id", "embedding").groupBy("dims", "region", "sub").applyInArrow(_build(k), "dims int, region long, sub long, tree binary"))

    queries = placed.where("is_query").groupBy("vec_id").agg(F.min(F.struct("dims", "embedding", "region")).alias("q")).select("vec_id", "q.*")
    queries = scratch.table(queries.withColumn("floor", F.lit(float("-inf"))))

    def search(visits: DataFrame) -> DataFrame:
        """Found rows of visits (vec_id, dims, embedding, floor, region): blocks of queries meet the trees of their regions."""
        some = visits.groupBy("dims", "region").agg(F.count("*").alias("q")).collect()  # a row for each region
        sizes = {(d, r): s for d, r, s in subs}
        plan = [(x["dims"], x["region"], sizes[x["dims"], x["region"]], -(-x["q"] // QUERY_ROWS)) for x in some if (x["dims"], x["region"]) in sizes]
        blocks = F.broadcast(spark.createDataFrame(plan, "dims int, region long, subs long, blocks long"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = index.join(blocks, ["dims", "region"]).withColumn("block", each("blocks")).select("dims", "region", "sub", "block", "tree")
        right = visits.join(blocks, ["dims", "region"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), "blocks")).withColumn("sub", each("subs"))
        right = right.select("dims", "region", "sub", "block", "vec_id", "embedding", "floor")
        keys = ["dims", "region", "sub", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, relax), FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = ranked(search(queries))
    if max([len(x) for x in regions.facts.values()], default=0) > 1:
        found = scratch.table(found)
        # the k-th score at home is the least that a row elsewhere needs
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        asked = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("least", "floor")).drop("least")

        def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dims").to_numpy()
                for d in np.unique(dims).tolist():
                    part = b.filter(pa.array(dims == d))
                    for at in range(0, part.num_rows, 4096):
                        own = part.slice(at, 4096)
                        ids, most = regions.bounds(d, _matrix(own.column("embedding")), relax)
                        go = ~(most < own.column("floor").to_numpy()[:, None]) & (ids[None, :] != own.column("region").to_numpy()[:, None])
                        offsets = np.concatenate(([0], np.cumsum(go.sum(axis=1)))).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.broadcast_to(ids, go.shape)[go]))
                        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("vec_id", "dims", "embedding", "floor")), lists], names=["vec_id", "dims", "embedding", "floor", "regions"])

        visits = scratch.table(asked.select("vec_id", "dims", "embedding", "floor", "region").mapInArrow(elsewhere, "vec_id long, dims int, embedding array<double>, floor double, regions array<long>"))
        more = search(visits.withColumn("region", F.explode("regions")).drop("regions"))
        found = ranked(found.drop("rank").unionByName(more))
    return found.select("query_id", "rank", "vec_id", "score")

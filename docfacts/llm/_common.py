"""Helpers shared by the training-data operators: durable cut points and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session, whose executors are its driver, gets a temporary
    folder where that is unset; on a cluster an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docfacts-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it for as long as a column of ``taken`` is called so in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    A lost executor costs a re-read of these files, never a recomputation of the work behind them.
    ``drop`` removes a table that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docfacts_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self.delete(df._docfacts_path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


#: Ways that the links of one node are dealt over tasks.
SPREAD = 32


def _least(links: DataFrame, how: str) -> DataFrame:
    """Links (u, v) with ``how`` of the least v of their u, as m.

    A node's links are counted map-side for the minimum and joined back in ``SPREAD`` parts by a hash of v, so that a node with
    very many links is no one task. A bit mask says which parts a node has, so the minimum is repeated for those only.
    """
    part = F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int")
    dealt = links.withColumn("s", part)
    low = dealt.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1L, s)")).alias("parts"))
    low = low.select("u", F.expr(how).alias("m"), F.explode(F.expr(f"filter(sequence(0, {SPREAD - 1}), i -> (parts & shiftleft(1L, i)) <> 0)")).alias("s"))
    return dealt.join(low, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected links.

    ``edges``: columns a, b (long). Returns (id, component), one row for each id that has a link to
    another id; component is the smallest id that can be reached. Self links and repeated links are ignored.

    Alternating large-star and small-star rounds: each is a map-side combined minimum for a node and a join back in
    parts, so a hub with very many links is spread over tasks, and the number of rounds grows with the logarithm of
    the size. Each round's links are a written table.
    """
    links = scratch.table(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    seen = None
    while True:
        stats = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if stats == seen:
            return links.selectExpr("u AS id", "v AS component")
        seen = stats
        both = links.unionByName(links.selectExpr("v AS u", "u AS v"))
        large = _least(both, "least(u, m)").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # in a star from large-star every v is below its u
        star = _least(large, "m")
        small = star.selectExpr("v AS u", "m AS v").unionByName(star.where("v = m").select("u", "v")).where("u <> v").distinct()
        after = scratch.table(small)
        scratch.drop(links)
        links = after


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole groups: rows must come with equal keys side by side; a table ends where a batch's last group begins.

    Each table holds one or more whole groups, so at most a batch and one group are in memory.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        t = new if held is None else pa.concat_tables([held, new])
        last = np.ones(len(t), dtype=bool)
        for k in keys:
            c = t[k].to_numpy()
            last &= c == c[-1]
        whole = 0 if last.all() else len(t) - int(last[::-1].argmin())
        if whole:
            yield t.slice(0, whole)
        held = t.slice(whole)
    if held is not None and len(held):
        yield held


def starts_of(t: pa.Table, *keys: str) -> list[tuple[int, int]]:
    """(first, end) of each group in a table of ``groups``."""
    new = np.zeros(len(t), dtype=bool)
    new[:1] = True
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], len(t)], strict=True))

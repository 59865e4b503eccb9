"""First filings, filing counts and sessions of keys over a stream, kept as state of each key.

A stream's rows come in any order and in any batches. Each operator keeps for a key what no later row can make superfluous, and
gives out the key's whole result with a version whenever a batch changes it; ``latest`` keeps the last version, so the results of any
split into batches equal the batch operator's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstFiling(StatefulProcessor):
    """State of a key: its least row in ``order`` and the set of its accessions, one map entry each."""

    def __init__(self, columns: list[str], order: list[str], counted: str, schema: StructType):
        self.columns, self.order, self.counted, self.schema = columns, order, counted, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.schema)
        self.seen = handle.getMapState("seen", StructType([self.schema[self.counted]]), "there boolean")
        self.size = handle.getValueState("size", "n long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        rank = lambda r: tuple((v is not None, v) for v in (r[self.columns.index(c)] for c in self.order))
        held = tuple(self.first.get()) if self.first.exists() else None
        n, version = self.size.get() if self.size.exists() else (0, 0)
        best, more = held, 0
        for part in rows:
            part = part[self.columns].astype(object).where(part[self.columns].notna(), None)
            for r in part.itertuples(index=False, name=None):
                if best is None or rank(r) < rank(best):
                    best = r
                name = (r[self.columns.index(self.counted)],)
                if name[0] is not None and not self.seen.containsKey(name):
                    self.seen.updateValue(name, (True,))
                    more += 1
        if best != held:
            self.first.update(best)
        if best != held or more:
            self.size.update((n + more, version + 1))
            yield pd.DataFrame([(*best, n + more, version + 1)], columns=[*self.columns, "n_filings", "version"])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """State of a key: its sessions as disjoint ranges of days, each with its first row and number of rows.

    Ranges that a late row joins are merged, so the state is as large as the key has sessions, not rows.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("sessions", "first_date date, last_date date, first_id string, n long")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = [tuple(s) for s in self.state.get()] if self.state.exists() else []
        for part in rows:
            held += [(d, d, i, 1) for d, i in zip(part["date"], part["id"], strict=True) if not pd.isna(d)]
        merged: list[tuple] = []
        for first, last, i, n in sorted(held):
            if merged and (first - merged[-1][1]) <= dt.timedelta(days=self.days):
                a, b, j, m = merged[-1]
                merged[-1] = (a, max(b, last), j, m + n)
            else:
                merged.append((first, last, i, n))
        if not merged:
            return
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.state.put(merged)
        self.version.update((version,))
        yield pd.DataFrame([(key[0], k, *s, version) for k, s in enumerate(merged)], columns=["key", "session", "first_date", "last_date", "first_id", "n", "version"])

    def close(self) -> None:
        pass


def first_filings(rows: DataFrame, key: list[str], order: list[str], counted: str = "accession") -> DataFrame:
    """Changes of the first row in ``order`` of each key with its number of distinct ``counted``: ``rows``' columns, n_filings, version.

    ``rows`` may be a stream. Nulls in ``order`` come first, as in Spark's sort; a null key is a key; a null ``counted`` is not
    counted. Rows that tie in ``order`` must be alike, so ``order`` should end in what names a row.
    """
    schema = rows.schema
    out = StructType([*schema.fields]).add("n_filings", "long").add("version", "long")
    return rows.groupBy(*key).transformWithStateInPandas(FirstFiling(rows.columns, order, counted, schema), out, "update", "none")


def sessions(rows: DataFrame, key: str, date: str, row_id: str, days: int) -> DataFrame:
    """Changes of each key's sessions: key, session (from 0), first_date, last_date, first_id, n, version; a change repeats all of a key's.

    A gap of more than ``days`` days starts a session. ``first_id`` is the least ``row_id`` (as text) of its first day. Rows
    without a date are left out; a null key is a key.
    """
    if days <= 0:
        raise ValueError("the window must be positive")
    own = rows.select(F.col(key).cast("string").alias("key"), F.col(date).cast("date").alias("date"), F.col(row_id).cast("string").alias("id"))
    out = "key string, session long, first_date date, last_date date, first_id string, n long, version long"
    return own.groupBy("key").transformWithStateInPandas(Sessions(days), out, "update", "none")


def latest(changes: DataFrame, key: list[str]) -> DataFrame:
    """The rows of the last version of each key."""
    last = changes.groupBy(*key).agg(F.max("version").alias("__v"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key] + [F.col("c.version") == F.col("l.__v")]
    return changes.alias("c").join(last.alias("l"), on).select("c.*").drop("version")


def append_changes(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all changes that are available below ``out``: a batch has a folder of its own, which a replayed batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(spark: SparkSession, changes: DataFrame, out: str, checkpoint: str, key: list[str]) -> DataFrame:
    """Runs a stream of changes over what its source has gained, and returns the last version of each key."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        append_changes(changes, out, checkpoint).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return latest(spark.read.schema(changes.schema).parquet(out), key)

"""Streams that keep state from run to run: a cache of results with a time to live, sources that only grow, merges step by step.

Each processor's state lies in the stream's checkpoint, so a run that ends or breaks off is followed by one that goes on from there, and what
arrives again changes nothing. Results don't depend on how rows are dealt over micro-batches, as long as none is later than the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import MERGE_STEPS
from ..session import scratch_path


#: Keys lie on so many shelves, and a shelf's state is one row: read and written once for all keys on it that a batch brings. Null keys have their own.
SHELVES = 256


def shelf(key: str) -> Column:
    """The shelf of a key."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(SHELVES))).cast("int").alias("shelf")


class Shelved(StatefulProcessor):
    """A processor whose state is a table for each shelf: `columns` (name, type), of which the first tell rows apart."""

    def __init__(self, columns: list[tuple[str, str]]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", ", ".join(f"{name} array<{kind}>" for name, kind in self.columns))

    def rows(self) -> list[tuple]:
        return list(zip(*self.table.get(), strict=True)) if self.table.exists() else []

    def keep(self, rows: list[tuple]) -> None:
        if rows:
            self.table.update(tuple(list(c) for c in zip(*rows, strict=True)))
        else:
            self.table.clear()

    def close(self) -> None:
        pass


def _listed(pdf: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    """Rows as Python's values; a column of nulls holds None."""
    return zip(*([None] * len(pdf) if pdf[c].isna().all() else pdf[c].tolist() for c in columns), strict=True)


class ResultCache(Shelved):
    """Lookups of a key's names: a hit within `millis` of the name's last miss, else a miss, which stores the result anew. A result is evicted when
    its time is over: when a later lookup finds it so, or by a timer of event time, which a shelf has for the first of its results."""

    def __init__(self, millis: int, kind: str):
        super().__init__([("key", kind), ("name", "string"), ("at", "long")])
        self.millis = millis

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "ord"], kind="stable")
        held = {(k, name): at for k, name, at in self.rows()}
        first, out = min(held.values(), default=None), []
        for k, name, at, order in _listed(pdf, "key", "name", "at", "ord"):
            stored = held.get((k, name))
            if stored is not None and at < stored + self.millis:
                out.append((k, name, order, "hit"))
                continue
            if stored is not None:
                out.append((k, name, None, "evicted"))
            out.append((k, name, order, "miss"))
            held[k, name] = at
        self._keep(held, first)
        yield self._told(out)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = {(k, name): at for k, name, at in self.rows()}
        gone = [k for k, at in held.items() if at + self.millis <= now]
        left = {k: at for k, at in held.items() if at + self.millis > now}
        self._keep(left, None)
        yield self._told([(*k, None, "evicted") for k in gone])

    def _keep(self, held: dict, first: int | None) -> None:
        """Stores the results, with a timer for the first of them unless that is `first`, which has one."""
        self.keep([(*k, at) for k, at in held.items()])
        least = min(held.values(), default=None)
        if least is not None and least != first:
            self.handle.registerTimer(least + self.millis)

    def _told(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "name", "ord", "outcome"], dtype=object)


def cached_results(stream: DataFrame, seconds: int) -> DataFrame:
    """[T-04, T-05, S-17] (key, name, ord, outcome) of lookups (key, name, ord, ts): hit or miss of each, and evicted, without ord, of each result
    whose time to live is over by the watermark."""
    ts = F.col("ts").cast("timestamp")  # times without a zone are read in the session's
    rows = stream.select(shelf("key"), "key", "name", "ord", ts.alias("ts"), F.unix_millis(ts).alias("at")).withWatermark("ts", "0 seconds")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("shelf").transformWithStateInPandas(ResultCache(seconds * 1000, kind), f"key {kind}, name string, ord long, outcome string", "append", "EventTime")


class SourceTracker(Shelved):
    """What a run finds of a source against the run before: how far it was read, and a digest of what was read, which doesn't depend on the order in
    which lines arrive."""

    def __init__(self, kind: str):
        super().__init__([("source", kind), ("run", "long"), ("lines", "long"), ("digest", "long")])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        held, out = {source: last for source, *last in self.rows()}, []
        for run, own in sorted(pdf.groupby("run"), key=lambda x: x[0]):
            number, sources = pd.factorize(own["source"], use_na_sentinel=False)
            sources = [None] if pd.isna(sources).all() else sources.tolist()
            line, digest = own["line"].to_numpy(np.int64), own["digest"].to_numpy(np.int64)
            seen = line < np.array([held[s][1] if s in held else 0 for s in sources], np.int64)[number]
            counts, whole, again = np.bincount(number, minlength=len(sources)).tolist(), np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
            np.add.at(whole, number, digest)
            np.add.at(again, number[seen], digest[seen])
            for source, lines, all_read, read_again in zip(sources, counts, whole.tolist(), again.tolist(), strict=True):
                last = held.get(source)
                if last and run <= last[0]:
                    continue  # this run was counted before
                if last is None:
                    status, start = "NEW", 0
                elif lines < last[1] or read_again != last[2]:
                    status, start = "CHANGED", 0
                else:
                    status, start = ("APPENDED" if lines > last[1] else "SAME"), last[1]
                held[source] = (int(run), lines, all_read)
                out.append((source, int(run), status, start, lines))
        if out:
            self.keep([(source, *last) for source, last in held.items()])
        yield pd.DataFrame(out, columns=["source", "run", "status", "start", "lines"], dtype=object)


def tracked_sources(stream: DataFrame) -> DataFrame:
    """[T-02, J-21] (source, run, status, start, lines) of lines (source, run, line, text), lines from 0: NEW, SAME, APPENDED from the line `start` on, or
    CHANGED where a source shrank or what was read before is no longer the same. All lines of a source's run come in one batch."""
    rows = stream.select(shelf("source"), "source", "run", F.col("line").cast("long").alias("line"), F.xxhash64("line", "text").alias("digest"))
    kind = dict(rows.dtypes)["source"]
    return rows.groupBy("shelf").transformWithStateInPandas(SourceTracker(kind), f"source {kind}, run long, status string, start long, lines long", "append", "None")


class MergeTracker(Shelved):
    """The step that a merge has reached: which events it has had, and the number of the last."""

    MARKS = ("prepared", "attempted", "commit_seen", "complete", "restored")
    STATES = (MERGE_STEPS[0], "prepared", "native_uncertain", "native_committed", "complete", "restored")

    def __init__(self, kind: str):
        super().__init__([("run_id", kind), ("ord", "long"), ("marks", "int")])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {merge: (last, marks) for merge, last, marks in self.rows()}
        bits, now = {m: 1 << i for i, m in enumerate(self.MARKS)}, {}
        for pdf in rows:
            for merge, order, event in _listed(pdf, "run_id", "ord", "event"):
                had = before.get(merge, (-1, 0))
                last, marks = now.get(merge, had)
                now[merge] = (max(last, int(order)), marks | bits.get(event, 0)) if order is not None and order > had[0] else (last, marks)
        self.keep([(merge, *had) for merge, had in (before | now).items()])
        out = [(merge, last, self.STATES[marks.bit_length()]) for merge, (last, marks) in now.items()]
        yield pd.DataFrame(out, columns=["run_id", "ord", "state"], dtype=object)


def tracked_merges(stream: DataFrame) -> DataFrame:
    """[T-06] (run_id, ord, state) after each batch of a stream of (run_id, ord, event): events up to the last number that a merge has had change nothing."""
    kind = dict(stream.dtypes)["run_id"]
    return stream.select(shelf("run_id"), "run_id", "ord", "event").groupBy("shelf").transformWithStateInPandas(MergeTracker(kind), f"run_id {kind}, ord long, state string", "append", "None")


def run_in_turns(spark: SparkSession, turns: list[DataFrame], build: Callable[[DataFrame], DataFrame], files: int = 1000) -> DataFrame:
    """All rows that build(stream) gives when `turns` arrive one after the other. After each the stream is started anew with the same checkpoint, as
    after a restart, and ends when it has read what is there, `files` files to a micro-batch. All lies in the folder of session.shared_dir."""
    base = scratch_path(spark, "turns")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in turns:
            rows.write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
            query = build(stream).writeStream.outputMode("append").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).format("parquet").start(f"{base}/out")
            query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.parquet(f"{base}/out")

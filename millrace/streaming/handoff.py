"""Streams: watched folders, appended lines, hand-offs, caches with a time to live."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path

STATES = ("not_started", "awaiting_report", "report_imported")


def watch_folder(spark: SparkSession, path: str, schema: str, kind: str = "json", per_batch: int = 1000) -> DataFrame:
    """[T-03] Rows of files that appear in a folder, each file once by the stream's own log, with the file's name."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(path)
    return stream.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def appended_lines(stream: DataFrame, offsets: DataFrame, source: str = "source", position: str = "line") -> DataFrame:
    """[T-02] Of a stream of lines those behind the offsets of an earlier run; offsets (source, offset) are a table."""
    return stream.join(offsets, source, "left").where(F.col(position) > F.coalesce("offset", F.lit(-1))).drop("offset")


def fresh_results(stream: DataFrame, at: str, seconds: int, key: list[str]) -> DataFrame:
    """[T-04, T-05, S-17] The first result of each key within a time to live; state older than that is dropped. Event times without a zone
    are read in the session's."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{seconds} seconds")
    return timed.dropDuplicatesWithinWatermark(key)


def _replay(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, rejected = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
    for event in rows["event"]:
        if event == "start":
            at = max(at, 1)
        elif event == "report" and at == 1:
            at = 2
        elif event == "report":
            rejected += 1
    state.update((at, rejected))
    yield pd.DataFrame({"run_id": [key[0]], "state": [STATES[at]], "rejected": [rejected]})


def handoff_states(events: DataFrame) -> DataFrame:
    """[T-07] (run_id, state, rejected) after each batch of a stream of (run_id, ord, event): a start awaits one report; reports before it
    or behind the first are rejected. The state of a run is two numbers. Events of a run come in order from batch to batch."""
    kind = dict(events.dtypes)["run_id"]
    return events.groupBy("run_id").applyInPandasWithState(_replay, f"run_id {kind}, state string, rejected long", "at int, rejected long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, key: list[str]) -> DataFrame:
    """Runs a stream over all that is there and returns the last row of each key. What it writes and its own log lie in the
    folder of session.shared_dir."""
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    columns = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("last")).select(*key, *[f"last.{c}" for c in columns])

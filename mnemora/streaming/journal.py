"""Structured Streaming over journals and events: keyed state, conflict checks, windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.journal import FLOOR, KEEP, MOST_REST, START


def tail(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8, fmt: str = "json") -> DataFrame:
    """New files of a folder, each renamed into it when whole; half-written lines never show."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def check_redelivery(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """key, digest, deliveries, conflict as the stream grows: the same key must keep its digest (the smallest one is
    shown). Built-in aggregates keep the state."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.min(digest).alias("digest"), F.count("*").alias("deliveries"), (F.min(digest) != F.max(digest)).alias("conflict"))


def key_state(rows: DataFrame, key: str, order: str, status: str, value: str) -> DataFrame:
    """The journal's state per key (latest status, last valid value, attempts, invalid) as it grows."""
    ok = F.col(status) == "ok"
    return rows.groupBy(key).agg(
        F.max_by(status, order).alias("latest_status"), F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))).alias("valid_value"),
        F.count("*").alias("attempts"), F.count_if(~ok).alias("invalid"),
    )


def pending(tasks: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Streamed tasks without a valid journal entry (stream-static anti join)."""
    return tasks.join(valid.select(key), key, "left_anti")


def deduplicated(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, ts: str, width: str, by: list[str], delay: str, slide: str | None = None) -> DataFrame:
    """Extension: counts and sums per event-time window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, key: str, delay: str) -> DataFrame:
    """Extension: sessions per key that a gap ends."""
    return rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def router(rows: DataFrame, endpoint: str, seconds: str, failed: str, at: str) -> DataFrame:
    """Endpoint state kept across batches, by the rules of operators.journal.router_replay: latency, count,
    failures in a row, and until when the endpoint rests. A batch's events are taken in order of at; they are
    folded as the functions l -> max(a l + b, m) that they are, each stretch of successes at once."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latency, n, failures, until = state.get if state.exists else (START, 0, 0, 0.0)
        log = pd.concat(list(frames)).sort_values(at, kind="stable")
        bad, took, clock = log[failed].to_numpy(bool), log[seconds].to_numpy(float), log[at].to_numpy(float)
        for s, e in zip(*_stretches(bad)):
            if bad[s]:
                failures += e - s
                latency = max(FLOOR, latency)
                until = float(clock[e - 1] + min(MOST_REST, 60 * 2 ** min(failures, 3)))
            else:
                failures = 0
                weights = (1 - KEEP) * KEEP ** np.arange(e - s - 1, -1, -1)
                latency = float(latency * KEEP ** (e - s) + (weights * took[s:e]).sum())
        n += len(log)
        state.update((float(latency), int(n), int(failures), until))
        yield pd.DataFrame({"endpoint": [k[0]], "latency": [float(latency)], "count": [int(n)], "failures": [int(failures)], "until": [until]})

    kinds = "latency double, count long, failures long, until double"
    return rows.select(endpoint, seconds, failed, at).groupBy(endpoint).applyInPandasWithState(step, f"endpoint string, {kinds}", kinds, "update", GroupStateTimeout.NoTimeout)


def _stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of runs of equal flags."""
    cuts = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    return [0, *cuts.tolist()][: len(flags)], [*cuts.tolist(), len(flags)]


def until_done(query, count: Callable[[], int], expected: int | None, idle: float, poll: float = 0.2) -> bool:
    """Waits for a running stream: True once so many results are there, False once none has come for idle
    seconds. The stream is stopped either way."""
    seen, since = -1, time.monotonic()
    try:
        while True:
            now = count()
            if expected is not None and now >= expected:
                return True
            if now != seen:
                seen, since = now, time.monotonic()
            elif time.monotonic() - since >= idle:
                return False
            query.awaitTermination(poll)
    finally:
        query.stop()


def dispatch(tasks: DataFrame, call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each batch of tasks through call, partition by partition, then to the sink; restarts where it was."""
    return tasks.writeStream.foreachBatch(lambda df, i: sink(df.mapInPandas(call, schema), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_complete(stream: DataFrame, spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation over all that is there in complete mode; each batch's whole result is a table of
    its own in a shared folder, and the last one is returned. Nothing is gathered on the driver."""
    made: list[int] = []

    def keep(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={i}")
        made.append(i)

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={made[-1]}") if made else spark.createDataFrame([], stream.schema)


def drain_to_files(stream: DataFrame, spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there in append mode, into Parquet in a shared folder."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(folder)


def update_batches(stream: DataFrame, spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """Update-mode rows of every batch with the batch's number, kept as Parquet."""

    def keep(df: DataFrame, i: int) -> None:
        df.withColumn("batch", F.lit(i)).write.mode("append").parquet(folder)

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.parquet(folder)

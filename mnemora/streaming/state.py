"""Keyed state of streams with timers, a bounded life and an initial state: keys that run until they are valid, and a
router of endpoints.

State lives in RocksDB on the executors (`store` sets it) and in the checkpoint; a restarted query goes on with it. Time is
event time: rows carry a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.journal import FIRST_REST, FLOOR, KEEP, MOST_REST, START

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class KeyRuns(StatefulProcessor):
    """Of each key: the digest of its content, attempts, whether one was valid, and the time of its last delivery. A key that
    wasn't delivered for `life` milliseconds of event time is forgotten."""

    def __init__(self, life: int, strict: bool):
        self.life, self.strict = life, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "digest string, attempts long, valid boolean, last long")

    def _keep(self, digest: str | None, attempts: int, valid: bool, last: int, before: int | None) -> None:
        if before is not None and before != last:
            self.handle.deleteTimer(before + self.life)
        if before != last:
            self.handle.registerTimer(last + self.life)
        self.held.update((digest, int(attempts), bool(valid), int(last)))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._keep(r["digest"], r["attempts"], r["valid"], int(r["last"]), None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        digest, attempts, valid, before = self.held.get() if self.held.exists() else (None, 0, False, None)
        last, out = before, []
        for r in pd.concat(list(rows)).sort_values("place", kind="stable").itertuples():
            digest = r.digest if digest is None else digest
            at = int(r.us // 1000)
            last = at if last is None else max(last, at)
            if r.digest != digest:
                if self.strict:
                    raise ValueError(f"{key[0]} came with another content")
                action = "conflict"
            elif valid:
                action = "skip"
            else:
                action, attempts = "run", attempts + 1
                valid = bool(r.ok)
            out.append((key[0], r.place, action, attempts))
        self._keep(digest, attempts, valid, last, before)
        yield pd.DataFrame(out, columns=["key", "place", "action", "attempt"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[3] + self.life <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "place": pd.Series([], dtype="int64"), "action": pd.Series([], dtype="object"), "attempt": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def key_runs(rows: DataFrame, spark: SparkSession, life: float, done: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """key, place, action, attempt of each delivery of rows (key, place, digest, ok, at; at has a watermark), in order of place within a batch:
    run, or skip once a run was valid, or conflict where the content isn't the key's first (an error if strict). A batch's
    deliveries of one key are in one task. Keys rest in the state for life seconds after their last delivery.

    done: key, digest, attempts, valid, last (milliseconds) to begin with, as `journal_state` gives them of an earlier journal."""
    store(spark)
    known = None if done is None else done.select("key", "digest", "attempts", "valid", "last").groupBy("key")
    return rows.select("key", "place", "digest", "ok", "at", F.unix_micros("at").alias("us")).groupBy("key").transformWithStateInPandas(
        KeyRuns(int(life * 1000), strict), "key string, place long, action string, attempt long", "append", "EventTime", known
    )


def journal_state(journal: DataFrame) -> DataFrame:
    """What key_runs begins with, of a journal's rows (key, place, digest, ok, at)."""
    return journal.groupBy("key").agg(
        F.min_by("digest", "place").alias("digest"), F.count("*").alias("attempts"), F.bool_or("ok").alias("valid"), (F.max(F.unix_millis("at"))).alias("last"),
    )


class Endpoint(StatefulProcessor):
    """Of each endpoint: smoothed latency, answers, failures in a row, requests in flight, and until when it rests. Events wait in a
    list until the watermark has passed them, so that they are applied in order of time however they come."""

    STATE = "latency double, count long, failures long, active long, until double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.STATE)
        self.waiting = handle.getListState("waiting", "at double, place long, kind string, seconds double")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        until = 0.0 if r["reachable"] else float(r["at"]) + FIRST_REST
        self.now.update((START if r["reachable"] else FLOOR, 0, 0, 0, until))
        if until:
            self.handle.registerTimer(int(until * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            at = f["us"].astype(float) / 1e6
            self.waiting.appendList(list(zip(at, f["place"].astype(int), f["kind"], f["seconds"].astype(float))))
            for due in {int(t * 1000) + 1 for t in (at.max(), at.min())}:
                self.handle.registerTimer(due)
        yield self._rows([])

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["endpoint", "at", "event", "latency", "count", "failures", "active", "until"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        s = self.now.get() if self.now.exists() else (START, 0, 0, 0, 0.0)
        out, left = [], []
        # a rest that ended before an event is told before it
        for at, place, kind, seconds in sorted(self.waiting.get()) if self.waiting.exists() else []:
            if at > passed:
                left.append((at, place, kind, seconds))
                continue
            if 0 < s[4] <= at:
                out.append((key[0], s[4], "rested", *s[:4], 0.0))
                s = (*s[:4], 0.0)
            s = applied(s, at, kind, seconds)
            out.append((key[0], at, kind, *s))
        if 0 < s[4] <= passed:
            out.append((key[0], s[4], "rested", *s[:4], 0.0))
            s = (*s[:4], 0.0)
        elif s[4]:
            self.handle.registerTimer(int(s[4] * 1000) + 1)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(int(left[0][0] * 1000) + 1)
        else:
            self.waiting.clear()
        self.now.update((float(s[0]), int(s[1]), int(s[2]), int(s[3]), float(s[4])))
        yield self._rows(out)

    def close(self) -> None:
        pass


def applied(s: tuple, at: float, kind: str, seconds: float) -> tuple:
    """An endpoint's state after an event: acquire, success or failure."""
    latency, count, failures, active, until = s
    if kind == "acquire":
        return latency, count, failures, active + 1, until
    active = max(0, active - 1)
    if kind == "success":
        return KEEP * latency + (1 - KEEP) * seconds, count + 1, 0, active, until
    failures += 1
    return max(FLOOR, latency), count + 1, failures, active, at + min(MOST_REST, 60 * 2.0 ** min(failures, 3))


def endpoints(rows: DataFrame, spark: SparkSession, start: DataFrame | None = None) -> DataFrame:
    """endpoint, at (seconds), event, and the state after it, of rows (endpoint, at, place, kind, seconds; at has a watermark) whose kind is
    acquire, success or failure: each event once the watermark has passed it, in order of (at, place), and an event
    "rested" at the end of each rest, which a timer tells where no other event comes.

    start: endpoint, reachable, at (seconds); one out of reach rests at first."""
    store(spark)
    known = None if start is None else start.select("endpoint", "reachable", "at").groupBy("endpoint")
    out = "endpoint string, at double, event string, latency double, count long, failures long, active long, until double"
    return rows.select("endpoint", "at", F.unix_micros("at").alias("us"), "place", "kind", "seconds").groupBy("endpoint").transformWithStateInPandas(Endpoint(), out, "append", "EventTime", known)

"""Streaming queries: each drains the events file as a stream and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder
from ..streaming import growing, state
from ..streaming import journal as S
from .base import query, r6
from .relations import ROUTER

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream (the bracket makes a pattern of the file's name)."""
    rows = S.tail(spark, f"{sf_dir}/event[s].parquet", EVENTS, fmt="parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT DISTINCT event_id % 500 AS k FROM events""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("event_id") % 500).alias("k"), "ts")
    out = S.deduplicated(rows, ["k"], "ts", "400 days").select("k")
    return S.drain_to_files(out, spark, folder(spark, "dedup"), folder(spark, "dedup-log"))


@query("""WITH j AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, CASE WHEN event_type='error' OR value<5 THEN 'error' ELSE 'ok' END AS status, value FROM events)
 SELECT key, arg_max(status,event_id) AS latest_status, round(arg_max(value,event_id) FILTER (WHERE status='ok'),6) AS valid_value, count(*) AS attempts, count(*) FILTER (WHERE status<>'ok') AS invalid FROM j GROUP BY 1""")
def stream_journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("event_type") == "error") | (F.col("value") < 5)
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "event_id", F.when(bad, "error").otherwise("ok").alias("status"), "value")
    state = S.drain_complete(S.key_state(rows, "key", "event_id", "status", "value"), spark, folder(spark, "state"), folder(spark, "state-log"))
    return state.withColumn("valid_value", r6(F.col("valid_value")))


@query("""SELECT CAST(event_id % 100 AS VARCHAR) AS key, count(*) AS deliveries, count(DISTINCT event_type)>1 AS conflict FROM events GROUP BY 1""")
def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("event_id") % 100).cast("string").alias("k"), F.col("event_type").alias("digest"))
    out = S.update_batches(S.check_redelivery(rows, "k", "digest"), spark, folder(spark, "redelivery"), folder(spark, "redelivery-log"))
    last = out.groupBy("key").agg(F.max_by(F.struct("deliveries", "conflict"), "batch").alias("x"))
    return last.select("key", "x.deliveries", "x.conflict")


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 6 hours, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain_complete(S.tumbling(events(spark, sf_dir), "ts", "6 hours", ["event_type"], "1 hour"), spark, folder(spark, "window"), folder(spark, "window-log"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT CAST(epoch(b)-3600*s AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS b, event_type, unnest(range(3)) AS s FROM events) GROUP BY ALL""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain_complete(S.tumbling(events(spark, sf_dir), "ts", "3 hours", ["event_type"], "1 hour", "1 hour"), spark, folder(spark, "sliding"), folder(spark, "sliding-log"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 4 hours THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
 SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts)))+14400 AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain_complete(S.sessions(events(spark, sf_dir), "ts", "4 hours", "user_id", "1 hour"), spark, folder(spark, "session"), folder(spark, "session-log"))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query("""SELECT event_id FROM events WHERE event_id % 1000 NOT IN (SELECT event_id % 1000 FROM events WHERE event_type='error')""")
def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select((F.col("event_id") % 1000).alias("key")).distinct()
    out = S.pending(events(spark, sf_dir).withColumn("key", F.col("event_id") % 1000), known, "key").select("event_id")
    return S.drain_to_files(out, spark, folder(spark, "pending"), folder(spark, "pending-log"))


@query(f"""WITH RECURSIVE {ROUTER} SELECT u AS endpoint, round(arg_max(l,i),6) AS latency, max(i) AS count, arg_max(k,i) AS failures, arg_max(t,i) AS until FROM s GROUP BY 1""")
def stream_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("endpoint"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("o"))
    out = S.update_batches(S.router(rows, "endpoint", "latency", "failed", "o"), spark, folder(spark, "router"), folder(spark, "router-log"))
    last = out.groupBy("endpoint").agg(F.max_by(F.struct("latency", "count", "failures", "until"), "batch").alias("x"))
    return last.select("endpoint", r6(F.col("x.latency")).alias("latency"), "x.count", "x.failures", "x.until")


@query("""WITH d AS (SELECT user_id % 60 AS k, event_id AS place, event_id % 37 = 0 AS other, value > 80 AS ok, first_value(event_id % 37 = 0) OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS first FROM events),
 f AS (SELECT *, other = first AND NOT coalesce(bool_or(other = first AND ok) OVER (PARTITION BY k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS run FROM d)
 SELECT CAST(k AS VARCHAR) AS key, place, CASE WHEN other <> first THEN 'conflict' WHEN run THEN 'run' ELSE 'skip' END AS action, CAST(sum(run::INT) OVER (PARTITION BY k ORDER BY place) AS BIGINT) AS attempt FROM f""")
def stream_key_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys run until they are valid; a key that isn't delivered for two days is forgotten, so the state is bounded."""
    rows = events(spark, sf_dir).withWatermark("ts", "1 hour").select(
        (F.col("user_id") % 60).cast("string").alias("key"), F.col("event_id").alias("place"), (F.col("event_id") % 37 == 0).cast("string").alias("digest"), (F.col("value") > 80).alias("ok"), F.col("ts").alias("at")
    )
    return S.drain_to_files(state.key_runs(rows, spark, 2 * 86_400), spark, folder(spark, "runs"), folder(spark, "runs-log"))


@query("""WITH RECURSIVE w AS (SELECT (floor(max(epoch_us(ts)) / 1000) - 60000) / 1000 AS w FROM events),
 e AS (SELECT user_id % 90 AS u, row_number() OVER (PARTITION BY user_id % 90 ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6 AS c, value AS v, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('view', 'click') THEN 'acquire' ELSE 'success' END AS kind FROM events, w WHERE epoch_us(ts) / 1e6 <= w),
 s AS (SELECT DISTINCT u, 0::BIGINT AS i, 0.0::DOUBLE AS c, '' AS kind, 30.0::DOUBLE AS l, 0::BIGINT AS n, 0::BIGINT AS k, 0::BIGINT AS a, 0.0::DOUBLE AS t FROM e UNION ALL
 SELECT s.u, e.i, e.c, e.kind, CASE e.kind WHEN 'failure' THEN greatest(90.0, s.l) WHEN 'success' THEN 0.8 * s.l + 0.2 * e.v ELSE s.l END, s.n + (e.kind <> 'acquire')::BIGINT, CASE e.kind WHEN 'failure' THEN s.k + 1 WHEN 'success' THEN 0 ELSE s.k END,
 CASE e.kind WHEN 'acquire' THEN s.a + 1 ELSE greatest(s.a - 1, 0) END, CASE WHEN e.kind = 'failure' THEN e.c + least(600.0, 60 * power(2, least(s.k + 1, 3))) WHEN s.t <= e.c THEN 0.0 ELSE s.t END FROM s JOIN e ON e.u = s.u AND e.i = s.i + 1),
 r AS (SELECT s.u, s.t AS c, 'rested' AS kind, s.l, s.n, s.k, s.a, 0.0 AS t FROM s LEFT JOIN e ON e.u = s.u AND e.i = s.i + 1, w WHERE s.t > 0 AND s.t <= coalesce(e.c, w))
 SELECT CAST(u AS VARCHAR) AS endpoint, round(c, 3) AS "at", kind AS event, round(l, 6) AS latency, n AS count, k AS failures, a AS active, round(t, 3) AS until FROM (SELECT u, c, kind, l, n, k, a, t FROM s WHERE i > 0 UNION ALL SELECT * FROM r)""")
def stream_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in flight, latency and rests of each endpoint after each event that the watermark has passed."""
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type").isin("view", "click"), "acquire").otherwise("success")
    rows = events(spark, sf_dir).withWatermark("ts", "1 minute").select((F.col("user_id") % 90).cast("string").alias("endpoint"), F.col("ts").alias("at"), F.col("event_id").alias("place"), kind.alias("kind"), F.col("value").alias("seconds"))
    out = S.drain_to_files(state.endpoints(rows, spark), spark, folder(spark, "endpoints"), folder(spark, "endpoints-log"))
    return out.select("endpoint", F.round("at", 3).alias("at"), "event", r6(F.col("latency")).alias("latency"), "count", "failures", "active", F.round("until", 3).alias("until"))


@query("""SELECT event_id, user_id, value FROM events""")
def stream_growing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines of files, read as a stream by bytes."""
    path = folder(spark, "lines")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value")).repartition(3).write.text(path)
    rows = growing.growing_lines(spark, path, range=64 << 10).select(F.from_json("value", "event_id long, user_id long, value double").alias("r")).select("r.*")
    return S.drain_to_files(rows, spark, folder(spark, "grown"), folder(spark, "grown-log"))


@query("""SELECT event_id, upper(event_type) AS done FROM events""")
def stream_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed tasks through a caller, partition by partition, until as many results are there as tasks."""
    path = folder(spark, "dispatched")

    def call(frames):
        for f in frames:
            yield f.assign(done=f["event_type"].str.upper())[["event_id", "done"]]

    kinds = "event_id long, done string"
    tasks = events(spark, sf_dir).select("event_id", "event_type")
    made: list[int] = []

    def sink(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={i}")
        made.append(spark.read.parquet(f"{path}/batch={i}").count())

    q = S.dispatch(tasks, call, kinds, sink, folder(spark, "dispatched-log"))
    if not S.until_done(q, lambda: sum(made), spark.read.parquet(f"{sf_dir}/events.parquet").count(), 600):
        raise RuntimeError("tasks are left")
    return spark.read.schema(kinds).parquet(path).select("event_id", "done")

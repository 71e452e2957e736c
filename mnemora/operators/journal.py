"""Append-only journals: last state per key, attempts, router replay. Works on batch rows; the streaming
package keeps the same state per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(rows: DataFrame, keys: list[str], order: str, status: str, value: str) -> DataFrame:
    """Per key: last status, last valid value, attempts and invalid attempts."""
    ok = F.col(status) == "ok"
    return rows.groupBy(*keys).agg(
        F.max_by(status, order).alias("latest_status"), F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))).alias("valid_value"),
        F.count("*").alias("attempts"), F.count_if(~ok).alias("invalid"),
    )


def summary(state: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Coverage of the expected keys by keys with a valid value."""
    joined = expected.select(key).distinct().join(state.select(key, F.col("valid_value").isNotNull().alias("ok"), "invalid"), key, "left")
    return joined.agg(
        F.count("*").alias("expected"), F.count_if("ok").alias("valid"), F.count_if(F.coalesce(~F.col("ok"), F.lit(True))).alias("open"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_attempts"),
        F.coalesce(F.count_if("ok") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"),
        (F.count_if("ok") == F.count("*")).alias("complete"),
    )


def valid_by_kind(state: DataFrame, expected: DataFrame, key: str, kind: str) -> DataFrame:
    """Per kind of the expected keys: how many there are and how many have a valid value."""
    ok = state.select(key, F.col("valid_value").isNotNull().alias("ok"))
    return expected.select(key, kind).distinct().join(ok, key, "left").groupBy(kind).agg(F.count("*").alias("expected"), F.count_if(F.coalesce("ok", F.lit(False))).alias("valid"))


#: Fixed values of the router: latency at the start, after a failure at least, and how much of the old one stays.
START, FLOOR, KEEP = 30.0, 90.0, 0.8
#: Seconds an endpoint rests that can't be reached at the start, and at most.
FIRST_REST, MOST_REST = 300.0, 600.0


def in_parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _part: the number of the range of (keys, order) that they lie in. A key of many rows lies in several
    parts, one after the other, so no task folds a key by itself; there are at most as many parts as partitions."""
    return rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())


def ewma(rows: DataFrame, keys: list[str], order: str, value: str, start: float = START, keep: float = KEEP) -> DataFrame:
    """keys, latency, n: keep * old + (1 - keep) * new over each key's rows in order, from start. The fold is a
    weighted sum, a value's weight being its distance from the end: parts are summed on their own, then a key's
    parts, one row each, in order."""
    w = Window.partitionBy(*keys, "_part").orderBy(F.desc(order))
    back = in_parts(rows, keys, [order]).withColumn("_back", F.row_number().over(w) - 1)
    parts = back.groupBy(*keys, "_part").agg(F.sum((1 - keep) * F.col(value) * F.pow(F.lit(keep), F.col("_back"))).alias("b"), F.count("*").alias("n"))
    log = F.sort_array(F.collect_list(F.struct("_part", "b", "n")))
    fold = F.aggregate(log, F.lit(float(start)), lambda l, p: l * F.pow(F.lit(keep), p["n"]) + p["b"])
    return parts.groupBy(*keys).agg(fold.alias("latency"), F.sum("n").alias("n"))


def rest(failures: Column) -> Column:
    """Seconds an endpoint rests after so many failures in a row."""
    return F.least(F.lit(MOST_REST), 60 * F.pow(F.lit(2.0), F.least(failures, F.lit(3))))


def router_start(endpoints: DataFrame) -> DataFrame:
    """State before the first event of (endpoint, reachable, at): an endpoint out of reach rests at first."""
    up = F.col("reachable")
    return endpoints.select("endpoint", F.when(up, START).otherwise(FLOOR).alias("latency"), F.when(up, 0.0).otherwise(F.col("at") + FIRST_REST).alias("until"))


def router_replay(events: DataFrame, endpoint: str, at: str, seconds: str, failed: str, start: DataFrame | None = None) -> DataFrame:
    """Endpoint state after its events in order of at (seconds on a clock): latency (smoothed over successes; a
    failure raises it to FLOOR at least), count, failures in a row, and until: when the last failure's rest ends.
    start: states to begin with, as router_start gives them. A null failed is a success.

    An event turns a latency l into max(a l + b, m), and so does any stretch of events. Each part's stretch is
    summed up on its own (a success weighs KEEP to the number of successes after it), then an endpoint's
    parts, one row each, are applied in order."""
    rows = events.select(endpoint, F.col(at).cast("double").alias("_o"), F.col(seconds).alias("_s"), F.coalesce(failed, F.lit(False)).alias("_f"))
    w = Window.partitionBy(endpoint, "_part").orderBy(F.desc("_o"), F.desc("_s"), F.desc("_f")).rowsBetween(Window.unboundedPreceding, -1)
    after = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    rows = in_parts(rows, [endpoint], ["_o", "_s", "_f"]).withColumn("_k", after((~F.col("_f")).cast("long")))
    rows = rows.withColumn("_b", F.when(F.col("_f"), 0.0).otherwise((1 - KEEP) * F.col("_s") * F.pow(F.lit(KEEP), F.col("_k"))))
    rows = rows.withColumn("_m", F.when(F.col("_f"), FLOOR * F.pow(F.lit(KEEP), F.col("_k")) + after(F.col("_b"))))
    runs = rows.groupBy(endpoint, "_part", "_k").agg(
        F.count("*").alias("n"), F.count_if(~F.col("_f")).alias("k"), F.sum("_b").alias("b"), F.max("_m").alias("m"),
        F.count_if("_f").alias("run"), F.max(F.when(F.col("_f"), F.col("_o"))).alias("last"),
    )
    place = F.when(F.col("run") > 0, F.col("_k"))
    parts = runs.groupBy(endpoint, "_part").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.max("m").alias("m"),
        F.min(place).alias("place"), F.min_by("run", place).alias("run"), F.min_by("last", place).alias("last"),
    )
    log = parts.groupBy(endpoint).agg(F.sort_array(F.collect_list(F.struct("_part", "n", "k", "b", "m", "place", "run", "last"))).alias("log"))
    latency, until = F.lit(START), F.lit(0.0)
    if start is not None:
        log = log.join(start.select(F.col("endpoint").alias(endpoint), F.col("latency").alias("_l"), F.col("until").alias("_u")), endpoint, "left")
        latency, until = F.coalesce("_l", latency), F.coalesce("_u", until)
    first = F.struct(latency.alias("latency"), F.lit(0).alias("count"), F.lit(0).alias("failures"), until.alias("until"))

    def step(s: Column, p: Column) -> Column:
        run = p["run"] + F.when(p["place"] == p["k"], s["failures"]).otherwise(0)
        failures = F.when(p["k"] == 0, s["failures"] + p["n"]).when(p["place"] == 0, p["run"]).otherwise(0)
        return F.struct(
            F.greatest(s["latency"] * F.pow(F.lit(KEEP), p["k"]) + p["b"], p["m"]).alias("latency"), (s["count"] + p["n"]).cast("int").alias("count"),
            failures.cast("int").alias("failures"), F.when(p["place"].isNull(), s["until"]).otherwise(p["last"] + rest(run)).alias("until"),
        )

    return log.select(endpoint, F.aggregate("log", first, step).alias("s")).select(endpoint, "s.*")


def transport_attempts(rows: DataFrame, key: str, transport: str) -> DataFrame:
    """Attempts, retries and last status of a record's list of (status, seconds)."""
    t = F.col(transport)
    return rows.select(
        key, F.size(t).alias("attempts"), F.size(F.filter(t, lambda x: x["status"].isin(408, 429) | (x["status"] >= 500))).alias("retryable"),
        F.element_at(t, -1)["status"].alias("last_status"), F.aggregate(t, F.lit(0.0), lambda s, x: s + x["seconds"]).alias("seconds"),
    )

"""A group-excluding nearest-neighbour reader without a table of pairs and without gathering the references.

References are dealt to buckets by their nearest pivot, and each bucket keeps its radius. By the triangle inequality a
bucket holds nothing more similar to a query than a bound that follows from the query's distance to the pivot and the radius.
Every query visits buckets in order of that bound, in rounds of growing length, until the bound falls below the
similarity of the k-th group that it has found; no visit beyond it could change its result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import written

#: Bytes of vectors that a task compares at once from each side; bytes of all pivots, which every task holds; how many
#: times more buckets a round visits than the round before; what rounding may add to a bound.
BLOCK_BYTES, PIVOT_BYTES, GROWTH, SLACK = 8 << 20, 16 << 20, 8, 2e-9
#: Distances or similarities that a task has at once; bytes of vectors that it passes on at once.
CELLS, VISIT_BYTES = 1 << 19, 2 << 20


def _matrix(column: pd.Series, width: int, what: str) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width))
    if any(len(v) != width for v in column):
        raise ValueError(f"{what} of another shape")
    out = np.stack(column.to_numpy())
    if not np.isfinite(out).all():
        raise ValueError(f"{what} with values that aren't finite")
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def deal(references: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """References with bucket, the number of their nearest pivot, their distance to it and their norm."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in references.schema)
    shared = references.sparkSession.sparkContext.broadcast(pivots)

    def nearest_pivot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"], width, "references")
            if not np.isfinite(f["value"].to_numpy(float)).all():
                raise ValueError("references with values that aren't finite")
            step = max(1, CELLS // len(shared.value))
            bucket, far = np.zeros(len(x), int), np.zeros(len(x))
            for i in range(0, len(x), step):
                d = _distances(x[i : i + step], shared.value)
                bucket[i : i + step], far[i : i + step] = d.argmin(axis=1), d.min(axis=1)
            yield f.assign(bucket=bucket, far=far, norm=np.sqrt((x * x).sum(axis=1)))

    return references.mapInPandas(nearest_pivot, f"{kinds}, bucket long, far double, norm double")


def bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, layers: np.ndarray) -> np.ndarray:
    """For each row of x and bucket what no similarity to a vector of the bucket exceeds."""
    gap = np.maximum(_distances(x, pivots) - radius - 1e-6, 0)
    return ((x * x).sum(axis=1)[:, None] + norm**2 - gap**2) / (2 * layers[:, None]) + 1e-9


def visits(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, width: int, first: int, last: int) -> DataFrame:
    """vec_id, grp, query_key, v, n, bucket: each query with the buckets that stand from first to last in the order of
    its bounds and whose bound reaches its floor."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((pivots, radius, norm))
    kept = ["vec_id", "grp", "query_key", "v", "n"]
    kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in kept)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, r, m = shared.value
        step, rows = max(1, CELLS // len(p)), max(1, VISIT_BYTES // (8 * max(1, width)))
        for f in frames:
            for i in range(0, len(f), step):
                part = f.iloc[i : i + step]
                bound = bounds(_matrix(part["v"], width, "queries"), p, r, m, part["n"].to_numpy(float))
                bound[bound < part["floor"].to_numpy(float)[:, None] - SLACK] = -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                row, at = np.nonzero(np.isfinite(np.take_along_axis(bound, order, 1)))
                for j in range(0, len(row), rows):  # a query stands in as many rows as it visits buckets
                    yield part[kept].iloc[row[j : j + rows]].assign(bucket=order[row[j : j + rows], at[j : j + rows]])

    return queries.mapInPandas(choose, f"{kinds}, bucket long")


def _met(k: int, width: int):
    """Of a block of queries and one of references: to each query the best reference of its k nearest groups."""

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values(["grp", "vec_id"], ignore_index=True)
            ref, grp, key, value = (held[c].to_numpy() for c in ("vec_id", "grp", "query_key", "value"))
            m = _matrix(held["v"], width, "references").T
            if not np.isfinite(value.astype(float)).all():
                raise ValueError("references with values that aren't finite")
            first = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            size = np.diff(np.append(first, len(grp)))
            step = max(1, CELLS // len(ref))
            for i in range(0, len(asked), step):
                part = asked.iloc[i : i + step]
                sim = np.round(_matrix(part["v"], width, "queries") @ m / part["n"].to_numpy()[:, None], 9)
                sim[(part["grp"].to_numpy()[:, None] == grp) | (part["query_key"].to_numpy()[:, None] == key)] = -np.inf
                top = np.maximum.reduceat(sim, first, axis=1)
                where = np.minimum.reduceat(np.where(sim == np.repeat(top, size, axis=1), np.arange(len(ref)), len(ref)), first, axis=1)
                for name, t, w in zip(part["vec_id"], top, where):
                    out += [(name, ref[w[j]], grp[w[j]], t[j], value[w[j]]) for j in np.lexsort((ref[w], -t))[:k] if np.isfinite(t[j])]
        return pd.DataFrame(out, columns=["vec_id", "ref", "rgrp", "sim", "value"])

    return best


def _part(name: str, of: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(name)), of)


def meet(asked: DataFrame, dealt: DataFrame, sizes: dict[int, int], block_rows: int, k: int, width: int) -> DataFrame:
    """vec_id, ref, rgrp, sim, value of queries (with a bucket) and the references of that bucket. A bucket's queries and
    references are cut into blocks by hash, block_rows on average, and each block of one side meets each of the other
    in a task."""
    spark = asked.sparkSession
    asks = {r["bucket"]: r["n"] for r in asked.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # as many rows as pivots
    cut = spark.createDataFrame([(b, -(-sizes[b] // block_rows), -(-n // block_rows)) for b, n in asks.items()], "bucket long, parts long, chunks long")
    cut = F.broadcast(cut)  # as many rows as pivots
    left = asked.join(cut, "bucket").withColumn("chunk", _part("chunk", F.col("chunks"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = dealt.join(cut, "bucket").withColumn("part", _part("part", F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    by = ["bucket", "part", "chunk"]
    kinds = ", ".join(f"{a} {dealt.schema[b].dataType.simpleString()}" for a, b in (("ref", "vec_id"), ("rgrp", "grp")))
    pairs = left.select(*by, "vec_id", "grp", "query_key", "v", "n").groupBy(*by).cogroup(right.select(*by, "vec_id", "grp", "query_key", "v", "value").groupBy(*by))
    return pairs.applyInPandas(_met(k, width), f"vec_id {asked.schema['vec_id'].dataType.simpleString()}, {kinds}, sim double, value double")


def bucketed(references: DataFrame, count: int, width: int) -> tuple[DataFrame, dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """References with their bucket, and of each bucket that has any: its rows, pivot, radius and largest norm. The pivots are the
    references of the smallest hashes."""
    pivots = np.array([r["v"] for r in references.orderBy(F.xxhash64("vec_id")).select("v").limit(count).collect()])  # PIVOT_BYTES at most
    if not np.isfinite(pivots).all():
        raise ValueError("references with values that aren't finite")
    dealt = written(deal(references, pivots, width), "reference-buckets")
    found = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).orderBy("bucket").collect()  # a row for each pivot
    used = [r["bucket"] for r in found]
    number = F.broadcast(references.sparkSession.createDataFrame(list(zip(used, range(len(used)))), "bucket long, at long"))  # as many
    dealt = dealt.join(number, "bucket").drop("bucket").withColumnRenamed("at", "bucket")
    return dealt, {i: r["n"] for i, r in enumerate(found)}, pivots[used], np.array([r["far"] for r in found]), np.array([r["norm"] for r in found])


def nearest_groups(
    queries: DataFrame, references: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, pivot_bytes: int = PIVOT_BYTES, growth: int = GROWTH, trace: list[int] | None = None
) -> DataFrame:
    """vec_id, rgrp, ref, sim, value: to each query the nearest reference of each of its k nearest groups, those of its own
    group or key left out. trace gets the number of buckets that all queries visited in each round."""
    shape = references.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.min("n"), F.max("n")).first()
    if shape[1] != shape[2] or shape[3] != shape[4]:
        raise ValueError("references of different shapes")
    rows, width = shape[0], shape[1] or 0
    block_rows = max(1, block_bytes // (8 * max(1, width)))
    count = max(1, min(math.isqrt(rows), -(-rows // block_rows), pivot_bytes // (8 * max(1, width))))
    kept = references.select("vec_id", "grp", "query_key", "v", "value")
    if count == 1:  # all that one task may compare at once: every query visits the one bucket there is
        dealt, sizes = kept.withColumn("bucket", F.lit(0).cast("long")), {0: rows} if rows else {}
        pivots, radius, norm = np.zeros((1, width)), np.full(1, np.inf), np.full(1, np.inf)
    else:
        dealt, sizes, pivots, radius, norm = bucketed(kept, count, width)
    types = {"vec_id": queries.schema["vec_id"].dataType, "ref": references.schema["vec_id"].dataType, "rgrp": references.schema["grp"].dataType}
    found = queries.sparkSession.createDataFrame([], ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", sim double, value double")
    if not sizes:
        return found
    first, last = 0, 1
    while first < len(sizes):
        floor = found.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("floor"))
        open_queries = queries.join(floor, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf))) if first else queries.withColumn("floor", F.lit(-math.inf))
        asked = visits(open_queries, pivots, radius, norm, width, first, last) if count > 1 else queries.withColumn("bucket", F.lit(0).cast("long"))
        asked = written(asked, "visits")
        n = asked.count()
        if trace is not None:
            trace.append(n)
        if not n:
            break
        more = found.unionByName(meet(asked, dealt, sizes, block_rows, k, width))
        best = more.groupBy("vec_id", "rgrp").agg(F.min_by(F.struct("ref", "sim", "value"), F.struct(-F.col("sim"), F.col("ref"))).alias("x")).select("vec_id", "rgrp", "x.*")
        top = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "ref")
        found = best.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n")
        first, last = last, last + (last - first) * growth
        if first < len(sizes):
            found = written(found, "nearest")
    return found


def nearest(queries: DataFrame, references: DataFrame, k: int, temperature: float, strict: bool = True, block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """value per query: softmax(similarity / temperature)-weighted mean over the nearest reference of each
    of the k nearest groups; references of the query's own group or key are no candidates. Similarity is the mean
    over layers of cosines, ties go to the smaller reference id.

    queries, references: (vec_id, grp, query_key, layers array<vector>[, value]), all layers and vectors of equal
    sizes and finite, else an error; a query without candidates is an error, or without a row if not strict."""
    if k < 1 or not (math.isfinite(temperature) and temperature > 0):
        raise ValueError("k has to be 1 at least, and the temperature finite and over 0")
    flat = F.flatten(F.transform("layers", lambda v: V.unit(v)))
    q = queries.select("vec_id", "grp", "query_key", flat.alias("v"), F.size("layers").alias("n"))
    r = references.select("vec_id", "grp", "query_key", flat.alias("v"), F.size("layers").alias("n"), F.col("value").cast("double").alias("value"))
    best = nearest_groups(q, r, k, block_bytes, **how).withColumn("_top", F.max("sim").over(Window.partitionBy("vec_id")))
    weight = F.exp((F.col("sim") - F.col("_top")) / temperature)
    out = best.groupBy("vec_id").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"), F.count("*").alias("effective_k"))
    if not strict:
        return out
    gone = F.raise_error(F.concat(F.lit("no reference for "), F.col("vec_id").cast("string"))).cast("long")
    return queries.select("vec_id").join(out, "vec_id", "left").withColumn("effective_k", F.coalesce("effective_k", gone))

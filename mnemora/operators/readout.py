"""Readouts over activation vectors: spherical class centroids, leave-one-group-out folds, their metrics, and (in
neighbours) group-excluding nearest references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import written
from .neighbours import BLOCK_BYTES, nearest  # noqa: F401

#: Bytes of the centers and sums of all folds that a task holds at once; more folds take another pass over the rows.
FOLD_BYTES = 64 << 20


def vector_sums(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """keys, dim, s, n: elementwise sums and counts per key. Every task adds its vectors up first, so what is
    shuffled is one vector for each task and key."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for f in frames:
            if f.empty:
                continue
            values = np.stack(f["_v"].to_numpy())
            for key, at in f.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                had = sums.setdefault(key, [0.0, 0])
                had[0], had[1] = had[0] + values[at].sum(axis=0), had[1] + len(at)
        if sums:
            yield pd.DataFrame({**{k: [key[i] for key in sums] for i, k in enumerate(keys)}, "_s": [x[0] for x in sums.values()], "_n": [x[1] for x in sums.values()]})

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.select(*keys, V.vec(vector).alias("_v")).mapInPandas(partial, f"{kinds}, _s array<double>, _n long")
    return parts.select(*keys, "_n", F.posexplode("_s").alias("dim", "_x")).groupBy(*keys, "dim").agg(F.sum("_x").alias("s"), F.sum("_n").alias("n"))


def packed(long: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One vector per key of rows (keys, dim, x)."""
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("p")).select(*keys, F.transform("p", lambda p: p["x"]).alias(name))


def mean_vector(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """Elementwise mean per key."""
    return packed(vector_sums(rows, keys, vector).withColumn("x", F.col("s") / F.col("n")), keys, "mean")


def centroids(train: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(center per by-key without regime, unit centroid per by-key, regime, cls) of rows (…, regime, cls, v)."""
    center = written(mean_vector(train, by).withColumnRenamed("mean", "center"), "centers")
    units = train.join(center, by).withColumn("u", V.unit(V.sub(V.vec("v"), F.col("center")), 1e-12))
    means = mean_vector(units, [*by, "regime", "cls"], "u")
    return center, means.withColumn("centroid", V.unit(F.col("mean"), 1e-12)).drop("mean")


def models(center: DataFrame, centroid: DataFrame, by: list[str]) -> DataFrame:
    """center and candidates (class and unit centroid) per by-key and regime, as a table in the shared folder."""
    held = centroid.groupBy(*by, "regime").agg(F.sort_array(F.collect_list(F.struct("cls", "centroid"))).alias("candidates"))
    return written(held.join(center, by), "models")


def judged(queries: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """queries with prediction: the class of the nearest centroid of its regime, the smaller class on a tie. A query
    whose key and regime have no model is left out."""
    u = V.unit(V.sub(V.vec("v"), F.col("center")), 1e-12)
    scored = queries.join(model, [*by, "regime"]).withColumn("_u", u)
    best = F.array_min(F.transform("candidates", lambda c: F.struct((-F.round(V.dot(F.col("_u"), c["centroid"]), 9)).alias("s"), c["cls"].alias("cls"))))
    return scored.select(*[c for c in queries.columns if c != "v"], best["cls"].alias("prediction"))


def predict(queries: DataFrame, train: DataFrame, by: list[str], item: str) -> DataFrame:
    """queries with the prediction of the centroids of train."""
    return judged(queries, models(*centroids(train, by), by), by)


def leave_group_out(train: DataFrame, group: str = "grp", fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """prediction of each reference row from a model without its group. A fold's center is the sum of all groups
    less its own, from a first pass. In a second pass every task holds the centers of all folds and adds each row's unit vector
    to the sums of all folds but its own: no row is multiplied, and a task sends one sum for each fold, regime and class.
    Folds whose centers and sums exceed fold_bytes are taken in several such passes."""
    spark = train.sparkSession
    sums = written(packed(vector_sums(train, ["layer", group]).withColumn("x", F.col("s")), ["layer", group], "s").join(
        train.groupBy("layer", group).agg(F.count("*").alias("n")), ["layer", group]), "group-sums")
    wide = sums.agg(F.max(F.size("s")), F.count("*")).first()
    classes = train.select("regime", "cls").distinct().count()
    passes = max(1, -(-wide[1] * (wide[0] or 0) * 8 * (1 + classes) // fold_bytes))
    part = F.pmod(F.xxhash64(group), F.lit(passes))
    whole = {}
    for r in vector_sums(sums.select("layer", F.col("s").alias("v")), ["layer"], "v").groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("p")).collect():  # a row for each layer
        whole[r["layer"]] = np.array([x["s"] for x in r["p"]])
    rows = dict(sums.groupBy("layer").agg(F.sum("n")).collect())  # a row for each layer
    found = None
    for i in range(passes):
        held = sums.where(part == i).collect()  # fold_bytes at most
        centers: dict = {}
        for r in held:
            left = rows[r["layer"]] - r["n"]
            if left:
                centers.setdefault(r["layer"], []).append((r[group], (whole[r["layer"]] - np.array(r["s"])) / left))
        if not centers:
            continue
        sums_of_units = fold_sums(train, centers, group)
        centroid = packed(sums_of_units.withColumn("x", F.col("s") / F.col("n")), ["layer", "fold", "regime", "cls"], "mean").withColumn("centroid", V.unit(F.col("mean"), 1e-12)).drop("mean")
        kind = f"layer {train.schema['layer'].dataType.simpleString()}, fold {train.schema[group].dataType.simpleString()}, center array<double>"
        center = spark.createDataFrame([(layer, fold, c.tolist()) for layer, x in centers.items() for fold, c in x], kind)
        model = models(center, centroid, ["layer", "fold"])
        found = model if found is None else found.unionByName(model)
    if found is None:
        return train.drop("v").withColumn("fold", F.col(group)).withColumn("prediction", F.col("cls")).limit(0)
    return judged(train.withColumn("fold", F.col(group)), found, ["layer", "fold"])


def fold_sums(train: DataFrame, centers: dict, group: str) -> DataFrame:
    """layer, fold, regime, cls, dim, s, n: sums over the rows of other groups of their unit vectors from the fold's center."""
    shared = train.sparkSession.sparkContext.broadcast({layer: ([f for f, _ in x], np.stack([c for _, c in x])) for layer, x in centers.items()})

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        had: dict[tuple, list] = {}
        for f in frames:
            for (layer, regime, cls), at in f.groupby(["layer", "regime", "cls"], sort=False, dropna=False).indices.items():
                folds, c = shared.value.get(layer, ([], None))
                if c is None:
                    continue
                if (total := had.get((layer, regime, cls))) is None:
                    total = had[layer, regime, cls] = [np.zeros(c.shape), np.zeros(len(c), np.int64)]
                x, own = np.stack(f["_v"].to_numpy()[at]), f[group].to_numpy()[at]
                step = max(1, (1 << 20) // c.size)
                for i in range(0, len(x), step):
                    away = x[i : i + step, None, :] - c
                    others = own[i : i + step, None] != np.array(folds, own.dtype)
                    away /= np.maximum(np.sqrt((away * away).sum(axis=2)), 1e-12)[:, :, None]
                    total[0] += np.einsum("rfd,rf->fd", away, others)
                    total[1] += others.sum(axis=0)
        for (layer, regime, cls), (s, n) in had.items():
            keep = n > 0
            folds = [f for f, k in zip(shared.value[layer][0], keep) if k]
            if folds:
                yield pd.DataFrame({"layer": layer, "fold": folds, "regime": regime, "cls": cls, "_s": list(s[keep]), "_n": n[keep]})

    kind = lambda c: train.schema[c].dataType.simpleString()
    schema = f"layer {kind('layer')}, fold {kind(group)}, regime {kind('regime')}, cls {kind('cls')}, _s array<double>, _n long"
    keys = ["layer", "fold", "regime", "cls"]
    parts = train.select("layer", group, "regime", "cls", V.vec("v").alias("_v")).mapInPandas(partial, schema)
    return parts.select(*keys, "_n", F.posexplode("_s").alias("dim", "_x")).groupBy(*keys, "dim").agg(F.sum("_x").alias("s"), F.sum("_n").alias("n"))


def class_recalls(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Per class that occurs: n, hits and recall of rows (cls, prediction)."""
    per = predictions.groupBy(*by, "cls").agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("cls")).cast("long")).alias("hits"))
    return per.withColumn("recall", F.col("hits") / F.col("n"))


def class_metrics(predictions: DataFrame, by: list[str], ordinal: bool = False) -> DataFrame:
    """accuracy and macro recall (over classes that occur) of rows (cls, prediction); with ordinal the mean
    distance of the levels as well."""
    out = class_recalls(predictions, by).groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("macro_recall"), F.count("*").alias("classes")
    )
    if not ordinal:
        return out
    return out.join(predictions.groupBy(*by).agg(F.avg(F.abs(F.col("prediction") - F.col("cls"))).alias("level_mae")), by)


def sliced_metrics(predictions: DataFrame) -> DataFrame:
    """class_metrics per layer, over all regimes (regime null) and per regime."""
    both = predictions.withColumn("regime", F.explode(F.array(F.lit(None).cast("long"), F.col("regime").cast("long"))))
    return class_metrics(both, ["layer", "regime"])


def layer_report(reference: DataFrame, held: DataFrame) -> DataFrame:
    """One row from metrics per layer of the reference folds and of the held-out rows: the layer of the best
    reference macro recall (the first of equals), the held-out scores there, and the layer of the held-out peak, which
    is only described."""
    first = lambda score: F.struct(-F.round(score, 9), F.col("layer"))
    chosen = reference.agg(F.min_by("layer", first("macro_recall")).alias("layer"), F.max("macro_recall").alias("reference_macro_recall"))
    peak = held.agg(F.min_by("layer", first("macro_recall")).alias("peak_layer"))
    return chosen.join(held.select("layer", F.col("macro_recall").alias("held_macro_recall"), F.col("accuracy").alias("held_accuracy")), "layer").join(peak)

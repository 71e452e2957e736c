"""Composition of counterfactual directions. Residuals are array columns; deltas are arrays of
struct(c, d): a memory's coefficient and its direction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import written


def directions(coefficients: Column, full: Column, without: Column) -> Column:
    """struct(c, d = full - without) per memory."""
    return F.zip_with(coefficients, without, lambda c, w: F.struct(c.alias("c"), V.sub(full, w).alias("d")))


def isolated_directions(coefficients: Column, only: Column, empty: Column) -> Column:
    return F.zip_with(coefficients, F.zip_with(only, empty, V.sub), lambda c, d: F.struct(c.alias("c"), d.alias("d")))


def computed_once(rows: DataFrame, prompts: list[str], compute: Callable[[DataFrame], DataFrame], heavy: int = 1024) -> DataFrame:
    """rows with v_<prompt>, the vector of each of its prompt columns: compute takes (digest, prompt) and returns (digest, v), and
    gets every distinct prompt once, however many rows share it. What it returns is written, and joined back by the digest.
    Prompts of more than one in `heavy` of all uses, fewer than `heavy`, meet their rows by a broadcast of that bound;
    the others are dealt by digest."""
    known = rows.select("*", *[F.sha2(F.coalesce(F.col(p), F.lit("")), 256).alias(f"_d_{p}") for p in prompts])
    uses = known.select(F.explode(F.array(*[F.struct(F.col(f"_d_{p}").alias("digest"), F.coalesce(F.col(p), F.lit("")).alias("prompt")) for p in prompts])).alias("x"))
    distinct = written(uses.groupBy("x.digest").agg(F.first("x.prompt").alias("prompt"), F.count("*").alias("n")), "distinct-prompts")
    made = written(compute(distinct.select("digest", "prompt")).join(distinct.select("digest", "n"), "digest"), "prompt-vectors")
    total = made.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(made.where(F.col("n") * heavy > total).select("digest", F.col("v").alias("_often")))
    rare = made.where(F.col("n") * heavy <= total).select("digest", F.col("v").alias("_rare"))
    for p in prompts:
        near = known.join(often.withColumnRenamed("digest", f"_d_{p}"), f"_d_{p}", "left")
        far = near.where(F.col("_often").isNull()).drop("_often").join(rare.withColumnRenamed("digest", f"_d_{p}"), f"_d_{p}").withColumnRenamed("_rare", f"v_{p}")
        known = near.where(F.col("_often").isNotNull()).withColumnRenamed("_often", f"v_{p}").unionByName(far)
    return known.drop(*[f"_d_{p}" for p in prompts])


def isolated_differences(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], only: str = "only", empty: str = "empty") -> DataFrame:
    """rows with delta, the vector of the prompt with one memory less that of the prompt without any, which many memories share."""
    done = computed_once(rows, [only, empty], compute)
    return done.withColumn("delta", V.sub(F.col(f"v_{only}"), F.col(f"v_{empty}"))).drop(f"v_{only}", f"v_{empty}")


def transport_sum(deltas: Column, width: int) -> Column:
    return V.weighted_sum(F.transform(deltas, lambda x: F.struct(x["c"].alias("k"), x["d"].alias("v"))), width)


def signed_mean(deltas: Column, width: int) -> Column:
    """Mean weighted direction of the positive memories plus that of the negative ones."""

    def side(sign: int) -> Column:
        own = F.filter(deltas, lambda x: F.signum(x["c"]) == sign)
        return V.scale(transport_sum(own, width), 1.0 / F.greatest(F.size(own), F.lit(1)))

    return V.add(side(1), side(-1))


def hybrid(coefficient: Column, isolated: Column, contextual: Column, mix: float = 0.5) -> Column:
    """The isolated direction, turned towards the contextual one (brought to its length) as far as the
    two agree: the share is mix times their cosine, none if that is negative."""
    gate = F.greatest(V.cosine(isolated, contextual), F.lit(0.0)) * mix
    matched = V.scale(contextual, V.norm(isolated) / F.greatest(V.norm(contextual), F.lit(1e-12)))
    return V.scale(V.let(gate, lambda g: F.zip_with(isolated, matched, lambda x, y: x * (1 - g) + y * g)), coefficient)


def hybrid_transport(coefficients: Column, isolated: Column, contextual: Column, width: int, mean_by_sign: bool = False, mix: float = 0.5) -> Column:
    """Sum, or mean by sign, of the hybrid directions of several memories; isolated and contextual: arrays of
    directions."""
    one = F.zip_with(isolated, contextual, lambda a, b: hybrid(F.lit(1.0), a, b, mix))
    deltas = F.zip_with(coefficients, one, lambda c, d: F.struct(c.alias("c"), d.alias("d")))
    return signed_mean(deltas, width) if mean_by_sign else transport_sum(deltas, width)


def joint_isolated(full: Column, clean: Column, positive: Column, width: int) -> Column:
    """From full to the state without the ignored memories, plus the positive isolated directions."""
    return V.add(V.sub(clean, full), transport_sum(F.filter(positive, lambda x: x["c"] > 0), width))


def policy_grouped(full: Column, without_positive: Column, without_negative: Column, coefficients: Column, width: int) -> Column:
    """Mean coefficient of each sign times the direction of all its memories together."""

    def side(sign: int, without: Column) -> Column:
        own = F.filter(coefficients, lambda c: F.signum(c) == sign)
        mean = V.total(own) / F.greatest(F.size(own), F.lit(1))
        return V.scale(V.sub(full, without), mean)

    return V.add(side(1, without_positive), side(-1, without_negative))


def grouped_clean(clean: Column, deltas: Column, width: int) -> Column:
    """Target of the clean base: support (s - 1) and dominate d act against it; zeros act not at all."""
    return V.add(clean, transport_sum(F.filter(deltas, lambda x: x["c"] != 0), width))


def policy_ordered(full: Column, clean: Column, without_positive: Column, negative: Column, positive: Column) -> Column:
    """Negatives are removed first (exactly, where the coefficient is -1); the positive direction is
    measured against what remains."""
    base = F.when(F.abs(negative + 1) < 1e-8, clean).otherwise(V.axpy(negative, V.sub(full, clean), full))
    return V.axpy(positive, V.sub(clean, without_positive), base)


def counterfactual_logits(full: Column, without: Column, coefficients: Column, width: int) -> Column:
    """full + sum of c (full - without)."""
    return V.add(full, transport_sum(directions(coefficients, full, without), width))


def grouped_logits(clean: Column, without: Column, coefficients: Column, width: int) -> Column:
    """Against the clean base, for memories with a coefficient: clean + sum of c (clean - without)."""
    return V.add(clean, transport_sum(F.filter(directions(coefficients, clean, without), lambda x: x["c"] != 0), width))


def frozen(steps: Column) -> Column:
    """Later steps keep the first step's direction: struct(only, empty) per step -> only."""
    first = V.sub(F.get(steps, F.lit(0))["only"], F.get(steps, F.lit(0))["empty"])
    return V.let(first, lambda d: F.transform(steps, lambda s, i: F.when(i == 0, s["only"]).otherwise(V.add(s["empty"], d))))


def steer(hidden: Column, direction: Column, alpha: Column | float, keep_norm: bool = False) -> Column:
    moved = V.axpy(alpha, direction, hidden)
    return V.radial_projection(moved, hidden) if keep_norm else moved


def adaptive_alpha(projection: Column, scale: Column, base: float, last: bool) -> Column:
    """The strength that a probe's projection asks for."""
    if last:
        return F.least(F.greatest(-0.06 * (projection - 0.5 * scale), F.lit(-0.6)), F.lit(0.4))
    return base * (projection - 1.4 * scale)


def readout(hidden: Column, weights: Column, bias: Column | None = None) -> Column:
    """W h + b; weights: an array of rows."""
    out = V.let(hidden, lambda h: F.transform(weights, lambda w: V.dot(w, h)))
    return out if bias is None else V.add(out, bias)


def gram(rows: DataFrame, key: str, rtol: float = 1e-4) -> DataFrame:
    """key, moved: the least-norm vector whose projections on the unit directions are c times their
    lengths, by the pseudo-inverse of the cosine Gram matrix; one memory takes the direct path.
    rows: (key, deltas array<struct<c, d>>). The rows of a batch with equally many directions of equal width are solved by one
    stacked decomposition: no shuffle."""

    def solved(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of c [rows, memories] and d [rows, memories, width]."""
        if d.shape[1] == 1:
            return c * d[:, 0]
        length = np.linalg.norm(d, axis=2)
        u = d / np.maximum(length, 1e-12)[:, :, None]
        inverse = np.linalg.pinv(u @ u.transpose(0, 2, 1), rcond=rtol, hermitian=True)
        return ((inverse @ (c * length)[:, :, None]).transpose(0, 2, 1) @ u)[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deltas = b.column(1)
            each = deltas.flatten()
            c, width = each.field("c").to_numpy(zero_copy_only=False), pc.list_value_length(each.field("d")).to_numpy(zero_copy_only=False)
            flat = each.field("d").flatten().to_numpy(zero_copy_only=False)
            at, count = np.cumsum(width) - width, pc.list_value_length(deltas).to_numpy(zero_copy_only=False)
            first = np.cumsum(count) - count
            if len(odd := np.flatnonzero(count == 0)):
                raise ValueError(f"{b.column(0)[int(odd[0])].as_py()} has no directions")
            size = width[first] if len(first) else np.zeros(0, np.int64)
            out: list = [None] * b.num_rows
            for m, w in set(zip(count.tolist(), size.tolist())):
                on = np.flatnonzero((count == m) & (size == w))
                places = first[on][:, None] + np.arange(m)
                if (width[places] != w).any():
                    raise ValueError("directions of different widths")
                moved = solved(c[places], flat[at[places][:, :, None] + np.arange(w)])
                for i, v in zip(on.tolist(), moved):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "moved"])

    return rows.select(key, F.transform("deltas", lambda x: F.struct(x["c"].cast("double").alias("c"), x["d"].cast("array<double>").alias("d"))).alias("deltas")).mapInArrow(
        run, f"`{key}` {rows.schema[key].dataType.simpleString()}, moved array<double>"
    )

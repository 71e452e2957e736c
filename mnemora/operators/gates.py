"""Strength gates and sampling over logit and attention arrays."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kl_gate(base: Column, moved: Column) -> Column:
    """KL(softmax(base) || softmax(base + 2 moved)) within [0, 2]."""
    p, q = V.log_softmax(base), V.log_softmax(V.axpy(2.0, moved, base))
    return clamp(V.total(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b))), 0.0, 2.0)


def fisher_gate(base: Column, moved: Column, budget: float = 0.1) -> Column:
    """sqrt(budget / variance of moved under softmax(base)) within [0.25, 2]; 1 where it hardly varies."""
    spread = lambda p: V.let(V.dot(p, moved), lambda m: V.total(F.zip_with(p, moved, lambda a, x: a * (x - m) * (x - m))))
    gate = lambda var: F.when(var <= 1e-8, 1.0).otherwise(clamp(F.sqrt(F.lit(budget) / F.greatest(var, F.lit(1e-8))), 0.25, 2.0))
    return V.let(V.let(V.softmax(base), spread), gate)


def finite(x: Column) -> Column:
    """Missing, NaN, infinite and negative signals count as 0."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), 0.0).otherwise(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))


def bounded_attention(mass: Column, by: list[str]) -> Column:
    """0.5 + s / (s + mean) with the mean over the sample; 1 where the mean is next to nothing."""
    s = finite(mass)
    mean = F.avg(s).over(Window.partitionBy(*by))
    return F.when(mean <= 1e-8, 1.0).otherwise(0.5 + s / F.greatest(s + mean, F.lit(1e-12)))


def normalized_attention(mass: Column, by: list[str]) -> Column:
    """sqrt(mass / mean) within [0.25, 4], a negative ratio as 0; 1 for the whole sample where the mean is no
    positive number, and for an infinite mass."""
    mean = F.avg(mass).over(Window.partitionBy(*by))
    ratio = F.greatest(mass / F.greatest(mean, F.lit(1e-8)), F.lit(0.0))
    gate = F.when(F.isnan(ratio), 1.0).otherwise(clamp(F.sqrt(ratio), 0.25, 4.0))
    return F.when(F.isnan(mean) | (mean <= 1e-8), 1.0).otherwise(gate)


def temporal(signal: Column, by: list[str], step: str, inverse: bool = False) -> Column:
    """0.5 + signal / (signal + reference); the reference is the first step's signal, and with inverse it
    stands above the line as well. Signals are taken as `finite` gives them."""
    signal = finite(signal)
    ref = F.first(signal).over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(signal + ref <= 1e-8, 1.0).otherwise(0.5 + (ref if inverse else signal) / F.greatest(signal + ref, F.lit(1e-12)))


def attention_mass(heads: Column, positions: Column) -> Column:
    """Mean over heads and the given key positions; 0 for none."""
    n = F.size(heads) * F.size(positions)
    s = V.total(F.transform(heads, lambda h: V.total(F.transform(positions, lambda p: F.coalesce(F.get(h, p), F.lit(0.0))))))
    return F.when(n == 0, 0.0).otherwise(s / F.greatest(n, F.lit(1)))


def attention_state(only: Column, empty: Column, coefficient: Column, isolated: Column, full: Column, control: str) -> tuple[Column, Column]:
    """(only, coefficient) under attention control: 'extract' scales the isolated direction by its gate,
    'steer' the coefficient by the gate of the full stream, 'both' does both, anything else neither."""
    extracted = V.axpy(isolated, V.sub(only, empty), empty) if control in ("extract", "both") else only
    return extracted, coefficient * full if control in ("steer", "both") else coefficient


#: Conditions of a run: how directions are measured, and the gate on their strength.
CONDITIONS: dict[str, tuple[str, str]] = {
    "dynamic_gate": ("every step", "attention"),
    "dynamic_no_gate": ("every step", "none"),
    "fixed_gate": ("first step", "attention"),
    "fixed_no_gate": ("first step", "none"),
    "dac_full_vocab": ("every step", "divergence"),
    "fixed_dac_full_vocab": ("first step", "divergence"),
}


def condition_gate(name: str, attention: Column, logits: Column, moved: Column) -> Column:
    """The strength under a named condition."""
    kind = CONDITIONS[name][1]
    return {"attention": lambda: attention, "none": lambda: F.lit(1.0), "divergence": lambda: kl_gate(logits, moved)}[kind]()


def shifted(positions: Column, padded: Column, length: Column) -> Column:
    """Token positions after padding on the left."""
    return F.transform(positions, lambda p: p + (padded - length))


def nucleus(logits: Column, top_p: float) -> Column:
    """array of struct(p, token) in order of falling probability (ties: token): tokens up to and with the
    one that crosses top_p."""
    ranked = F.transform(F.array_sort(F.transform(V.softmax(logits), lambda x, i: F.struct((-F.round(x, 12)).alias("n"), i.alias("token"), x.alias("p")))), lambda s: F.struct(s["p"].alias("p"), s["token"].alias("token")))
    step = lambda acc, x: F.struct(
        (acc["sum"] + x["p"]).alias("sum"),
        F.when(acc["sum"] < top_p, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
    )
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<p:double,token:int>>").alias("kept"))
    return F.aggregate(ranked, zero, step)["kept"]


def sample(kept: Column, draw: Column) -> Column:
    """The token at which the renormalised cumulative probability reaches draw; the last one at most."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("token"))

    def reached(mass: Column) -> Column:
        step = lambda acc, x: F.struct(
            (acc["sum"] + x["p"] / mass).alias("sum"),
            F.when(acc["token"].isNull() & (acc["sum"] + x["p"] / mass >= draw), x["token"]).otherwise(acc["token"]).alias("token"),
        )
        return F.aggregate(kept, zero, step)["token"]

    found = V.let(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["p"]), reached)
    return F.coalesce(found, F.element_at(kept, -1)["token"])


def greedy(logits: Column) -> Column:
    """The first token of the largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")

"""Vector algebra over array<double> columns with higher-order functions (JVM side, no row explosion)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def vec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(DOUBLES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside the lambda of a higher-order function an outer
    expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    if not isinstance(k, Column):
        return F.transform(a, lambda x: x * k)
    return let(k, lambda kk: F.transform(a, lambda x: x * kk))


def axpy(k: Column | float, a: Column, b: Column) -> Column:
    """b + k a."""
    if not isinstance(k, Column):
        return F.zip_with(a, b, lambda x, y: y + x * k)
    return let(k, lambda kk: F.zip_with(a, b, lambda x, y: y + x * kk))


def unit(a: Column, floor: float = 1e-6) -> Column:
    """a over its length, which counts as floor at least."""
    return scale(a, 1.0 / F.greatest(norm(a), F.lit(floor)))


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def rounded(a: Column, digits: int = 6) -> Column:
    """Rounded elements; a negative zero becomes zero."""
    return F.transform(a, lambda x: F.round(x, digits) + F.lit(0.0))


def softmax(a: Column) -> Column:
    shifted = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def log_softmax(a: Column) -> Column:
    shifted = let(F.array_max(a), lambda top: F.transform(a, lambda x: x - top))
    return let(shifted, lambda s: let(F.log(total(F.transform(s, F.exp))), lambda z: F.transform(s, lambda x: x - z)))


def vector_sum(vectors: Column, width: Column | int) -> Column:
    """Sum over an array of vectors; zeros of the given width for none."""
    zero = F.array_repeat(F.lit(0.0), width if isinstance(width, Column) else F.lit(width))
    return F.aggregate(vectors, zero, add)


def weighted_sum(items: Column, width: Column | int) -> Column:
    """Sum of k * v over an array of structs (k, v)."""
    zero = F.array_repeat(F.lit(0.0), width if isinstance(width, Column) else F.lit(width))
    return F.aggregate(items, zero, lambda acc, it: F.zip_with(acc, it["v"], lambda x, y: x + y * it["k"]))


def blocks(a: Column, count: int, width: int) -> Column:
    """a cut into count vectors of width elements."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(a, i * width + 1, width))


def radial_projection(moved: Column, base: Column) -> Column:
    """moved, brought to the length of base."""
    return scale(moved, norm(base) / F.greatest(norm(moved), F.lit(1e-12)))


def tangent_transport(base: Column, move: Column) -> Column:
    """base turned on its sphere along the part of move that is tangent to it, a quarter turn at most."""
    r = norm(base)
    tangent = axpy(-dot(base, move) / F.pow(F.greatest(r, F.lit(1e-12)), 2), base, move)

    def turned(t: Column) -> Column:
        angle = F.least(norm(t) / F.greatest(r, F.lit(1e-12)), F.lit(math.pi / 2))
        along = scale(t, r / F.greatest(norm(t), F.lit(1e-12)) * F.sin(angle))
        return F.when(norm(t) <= 1e-12, base).otherwise(add(scale(base, F.cos(angle)), along))

    return let(tangent, turned)


def last_position(mask: Column) -> Column:
    """Index of the last unmasked position, 0 for none."""
    return F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x) - 1, F.lit(0))


def position_ids(mask: Column) -> Column:
    """Running count of unmasked positions less one; 0 where masked."""
    n = F.size(mask)
    run = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(mask, F.lit(1), i), F.lit(0), lambda s, x: s + x) - 1)
    return F.zip_with(run, mask, lambda p, m: F.when(m == 0, 0).otherwise(p))

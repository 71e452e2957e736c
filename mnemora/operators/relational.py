"""Joins and set operations that take more than one built-in step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def anti(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def matching_hash(left: DataFrame, right: DataFrame, on: str, text: str, digest: str) -> DataFrame:
    """left joined with right on a key where right's digest is that of left's text."""
    return left.join(right, on).where(F.sha2(F.col(text), 256) == F.col(digest))


def aligned(rows: DataFrame, source: DataFrame, on: list[str], position: str) -> DataFrame:
    """rows with the source's columns of their key, each row's position kept as a column; a row without a source row
    is an error, and so is a key that the source has twice."""
    once = source.groupBy(*on).agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in source.columns if c not in on])
    checked = F.when(F.col("_c") == 1, F.col(position)).otherwise(F.raise_error(F.concat(F.lit("not one source row for "), F.concat_ws("::", *on))).cast(rows.schema[position].dataType))
    return rows.join(once, on, "left").withColumn(position, checked).drop("_c")


def divide(required: DataFrame, present: DataFrame, group: str, key: list[str]) -> DataFrame:
    """Groups all of whose required keys are present."""
    hit = required.join(present.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.groupBy(group).agg(F.every(F.coalesce("_hit", F.lit(False))).alias("all_present"))


def overlap(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) of the same by-key that overlap.

    Both sides are cut into cells of `width` and joined on (by, cell) by a hash, not by a nested loop;
    a pair that shares several cells is kept in the first of them."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    l, r = left.withColumn("_cell", cells("l_start", "l_end")), right.withColumn("_cell", cells("r_start", "r_end"))
    first = F.floor(F.greatest("l_start", "r_start") / width)
    return l.join(r, [*by, "_cell"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_cell") == first)).drop("_cell")


def positional(left: Column, right: Column) -> Column:
    """Pairs of two arrays, cut to the shorter one."""
    return F.slice(F.arrays_zip(left.alias("l"), right.alias("r")), F.lit(1), F.least(F.size(left), F.size(right)))


def overlap_counts(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Distinct common values per named key (a contamination audit): name, left, right, common."""
    names = list(keys)
    side = lambda df, i, tag: df.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), keys[n][i])])).alias("name", "value")).where("value is not null").distinct().withColumn(tag, F.lit(1))
    both = side(left, 0, "l").join(side(right, 1, "r"), ["name", "value"], "full")
    return both.groupBy("name").agg(F.count("l").alias("left"), F.count("r").alias("right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))


def is_proper_subset(inner: DataFrame, outer: DataFrame, on: str) -> DataFrame:
    """One row: missing keys, and whether inner is a proper subset."""
    a, b = inner.select(on).distinct(), outer.select(on).distinct()
    both = a.withColumn("i", F.lit(1)).join(b.withColumn("o", F.lit(1)), on, "full")
    return both.agg(F.count_if(F.col("o").isNull()).alias("missing"), ((F.count_if(F.col("o").isNull()) == 0) & (F.count_if(F.col("i").isNull()) > 0)).alias("proper"))

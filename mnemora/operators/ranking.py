"""Deterministic ranks, group splits and greedy covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: the prefix of hashed group ids.
SALT = "rq1-reference"


def hash_key(seed: int, key: Column, salt: str = SALT) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), F.lit(str(seed)), key.cast("string")), 256)


def hash_rank(groups: DataFrame, key: str, seed: int, by: list[str] | None = None, salt: str = SALT, digits: int = 3) -> DataFrame:
    """rank: 1.. in order of the seeded hash, then the key, within by.

    No task ranks all rows: they are ranked within buckets of the hash's first digits, and a bucket starts
    after the rows of those before it (at most 16**digits counts per by-key)."""
    by = by or []
    rows = groups.withColumn("_h", hash_key(seed, F.col(key), salt)).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = rows.withColumn("_n", F.row_number().over(inside)).join(starts, [*by, "_b"])
    return ranked.withColumn("rank", (F.col("_n") + F.col("_before")).cast("long")).select(*groups.columns, "rank")


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_per_key(rows: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row of each key with the highest score; ties take the first in order of tie."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, keys: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def allocation(single: Column, total: Column, fraction: float) -> Column:
    """Groups of the single regime in a reference of a fraction of all groups."""
    count = F.least(F.greatest(F.bround(total * fraction), F.lit(6)), total - 6)
    share = F.bround(count * single / total)
    return F.least(F.greatest(share, F.lit(3)), count - 3).cast("long")


def label_sets(groups: DataFrame, key: str, labels: str, rank: str, wanted: list, count: int) -> DataFrame:
    """has (the wanted labels of a group), and its first `count` groups in order of rank: 2**len(wanted) sets at most. A
    set with many groups is cut down before the shuffle."""
    has = F.array_sort(F.array_intersect(F.array_distinct(labels), F.array(*map(F.lit, wanted))))
    first = Window.partitionBy("_has").orderBy("r")
    kept = groups.select(has.alias("_has"), F.col(key).alias("k"), F.col(rank).alias("r")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= count)
    return kept.groupBy("_has").agg(F.sort_array(F.collect_list(F.struct("r", "k"))).alias("first"))


def greedy_cover(groups: DataFrame, key: str, labels: str, rank: str, wanted: list, seen: int, count: int) -> list:
    """Keys chosen one by one: the group with most of the wanted labels still short of `seen`, ties by rank, until
    every label has been seen that often or no group helps; then by rank up to count. An error if that
    gives another number of keys, or a label stays short.

    Groups with the same wanted labels differ by rank only, so all choices are made from one table: the first groups of
    each set of labels, as many as can be chosen."""
    most = max(count, seen * len(wanted))
    sets = [(set(r["_has"] or []), [(x["r"], x["k"]) for x in r["first"]]) for r in label_sets(groups, key, labels, rank, wanted, most).collect()]
    need, chosen = dict.fromkeys(wanted, seen), []

    def take(has: set, first: list) -> None:
        chosen.append(first.pop(0)[1])
        for x in has:
            need[x] -= 1

    while any(n > 0 for n in need.values()):
        gains = [(-sum(need[x] > 0 for x in has), first[0], i) for i, (has, first) in enumerate(sets) if first]
        best = min(gains, default=(0, None, 0))
        if best[0] == 0:
            break
        take(*sets[best[2]])
    while len(chosen) < count and (left := [(first[0], i) for i, (_, first) in enumerate(sets) if first]):
        take(*sets[min(left)[1]])
    if len(chosen) != count:
        raise ValueError(f"{len(chosen)} groups cover the labels, not {count}")
    if short := [x for x, n in need.items() if n > 0]:
        raise ValueError(f"labels seen less than {seen} times: {short}")
    return chosen


def least_loaded(endpoints: DataFrame) -> DataFrame:
    """The endpoint of the smallest ((active + 1) latency / cap, count) among those with room."""
    score = (F.col("active") + 1) * F.col("latency") / F.col("cap")
    return endpoints.where("active < cap and cooldown <= 0").agg(F.min_by("endpoint", F.struct(score, F.col("count"), F.col("endpoint"))).alias("endpoint"))

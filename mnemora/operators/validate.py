"""Constraints as violation tables: each function returns rows (constraint, key, detail), none if all
is well. `require` turns such a table into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(df: DataFrame, name: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("constraint"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def unique(rows: DataFrame, keys: list[str], name: str = "unique") -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _said(found, name, F.concat_ws("::", *keys), F.col("n"))


#: The splits a group can be in.
SPLITS = ("calibration", "heldout")


def predictions(rows: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """uid is sample::memory, a finite coefficient, a known split, one split per sample; with memories
    (sample_id, memory_id) a prediction for each of them and for no other."""
    bad = F.concat_ws(
        ",",
        F.when(F.col("uid") != F.concat_ws("::", "sample_id", "memory_id"), "uid"),
        F.when(F.col("coefficient").isNull() | F.isnan("coefficient") | (F.abs("coefficient") == float("inf")), "coefficient"),
        F.when(F.col("split").isNull() | ~F.col("split").isin(*SPLITS), "split"),
    )
    each = _said(rows.withColumn("_bad", bad).where("_bad <> ''"), "prediction", F.col("uid"), F.col("_bad"))
    mixed = rows.groupBy("sample_id").agg(F.countDistinct("split").alias("n")).where("n > 1")
    found = unique(rows, ["uid"]).unionByName(each).unionByName(_said(mixed, "one_split", F.col("sample_id"), F.col("n")))
    return found if memories is None else found.unionByName(coverage(memories, rows, ["sample_id", "memory_id"]))


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing from found, and keys of found that nobody expects."""
    key = F.concat_ws("::", *keys)
    missing = expected.select(*keys).distinct().join(found, keys, "left_anti")
    orphan = found.select(*keys).distinct().join(expected, keys, "left_anti")
    return _said(missing, "missing", key, F.lit("")).unionByName(_said(orphan, "orphan", key, F.lit("")))


def calibration(groups: DataFrame, group: str, split: str, most: float = 0.2, sample: str | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Known splits, no group in two of them; at most a share of all groups in calibration. With sample, no sample
    twice. With chosen (a column of the group's or, with sample, the sample's ids that calibration was made of): some id is chosen, each
    of them exists, and what they name is what calibration holds."""
    unknown = groups.where(F.col(split).isNull() | ~F.col(split).isin(*SPLITS)).select(group, split).distinct()
    two = groups.groupBy(group).agg(F.countDistinct(split).alias("n")).where("n > 1")
    part = groups.select(group, split).distinct().agg((F.count_if(F.col(split) == "calibration") / F.countDistinct(group)).alias("share")).where(F.col("share") > most)
    found = _said(two, "conflict", F.col(group), F.col("n")).unionByName(_said(part, "calibration_share", F.lit("all"), F.round("share", 6))).unionByName(_said(unknown, "split", F.col(group), F.col(split)))
    if sample is not None:
        found = found.unionByName(unique(groups, [sample], "duplicate_sample"))
    if chosen is None:
        return found
    key = sample or group
    ids = chosen.select(F.col(chosen.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    none = ids.agg(F.count("*").alias("n")).where("n = 0")
    held = groups.where(F.col(split) == "calibration").select(key).distinct()
    missing = _said(ids.join(groups, key, "left_anti"), "missing_calibration", F.col(key), F.lit(""))
    other = _said(held.join(ids, key, "left_anti"), "not_chosen", F.col(key), F.lit(""))
    apart = _said(ids.join(groups.select(key, split), key).where(F.col(split) != "calibration").select(key).distinct(), "not_in_calibration", F.col(key), F.lit(""))
    return found.unionByName(_said(none, "no_calibration", F.lit("all"), F.lit(""))).unionByName(missing).unionByName(other).unionByName(apart)


def complete_levels(rows: DataFrame, group: str, level: str, levels: list[int]) -> DataFrame:
    """Groups whose levels aren't exactly the given ones."""
    found = rows.groupBy(group).agg(F.sort_array(F.collect_list(level)).alias("x"))
    want = F.array(*[F.lit(x) for x in levels]).cast(found.schema["x"].dataType)
    return _said(found.where(F.col("x") != want), "levels", F.col(group), F.array_join(F.col("x").cast("array<string>"), ","))


def splits(reference: DataFrame, test: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Disjoint, and together all groups."""
    both = _said(reference.select(key).intersect(test.select(key)), "overlap", F.col(key), F.lit(""))
    return both.unionByName(coverage(groups, reference.select(key).union(test.select(key)), [key]))


def vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    v = F.col(vector)
    bad = F.concat_ws(",", F.when(F.size(v) != width, "width"), F.when(F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))), "not finite"))
    return _said(rows.withColumn("_bad", bad).where("_bad <> ''"), "vector", F.col(key), F.col("_bad"))


def same_in_group(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    found = rows.groupBy(group).agg(F.countDistinct(F.struct(*columns)).alias("n")).where("n > 1")
    return _said(found, "differs", F.col(group), F.col("n"))


def label_cover(rows: DataFrame, by: str, label: str, labels: list[str]) -> DataFrame:
    found = rows.groupBy(by).agg(F.collect_set(label).alias("x")).withColumn("gone", F.array_except(F.array(*map(F.lit, labels)), "x"))
    return _said(found.where(F.size("gone") > 0), "labels", F.col(by), F.array_join(F.sort_array("gone"), ","))


def digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (name, content) against manifest (name, sha256)."""
    found = files.select("name", F.sha2("content", 256).alias("found")).join(manifest, "name", "full")
    return _said(found.where(~F.col("found").eqNullSafe(F.col("sha256"))), "digest", F.col("name"), F.col("found"))


def order(rows: DataFrame, manifest: DataFrame, key: str, position: str) -> DataFrame:
    """Keys at another position than the manifest's."""
    both = rows.select(key, F.col(position).alias("a")).join(manifest.select(key, F.col(position).alias("b")), key, "full")
    return _said(both.where(~F.col("a").eqNullSafe(F.col("b"))), "order", F.col(key), F.concat_ws("/", "a", "b"))


def unchanged(now: DataFrame, before: DataFrame, key: str, digests_: list[str]) -> DataFrame:
    """Keys whose digests changed since they were recorded."""
    b = before.select(key, *[F.col(c).alias(f"_{c}") for c in digests_])
    differs = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in digests_])
    return _said(now.join(b, key).withColumn("_d", differs).where("_d <> ''"), "changed", F.col(key), F.col("_d"))


def single_line(rows: DataFrame, key: str, text: str, line: str) -> DataFrame:
    n = F.size(F.filter(F.split(F.col(text), "\n", -1), lambda x: x == F.col(line)))
    return _said(rows.withColumn("_n", n).where("_n <> 1"), "line", F.col(key), F.col("_n"))


def artifact(rows: DataFrame, source: DataFrame, vector: str, layers: int, width: int) -> DataFrame:
    """Rows (sample_id, memory_id, group_id, gold_policy, vector as layers of vectors) against source rows of the
    same keys: each key once and in both, group and policy as in the source, so many layers of finite vectors."""
    keys = ["sample_id", "memory_id"]
    key = F.concat_ws("::", *keys)
    both = rows.join(source.select(*keys, F.col("group_id").alias("_g"), F.col("gold_policy").alias("_p")), keys)
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    bad = F.concat_ws(
        ",",
        F.when(F.col("group_id").isNotNull() & (F.col("group_id") != F.col("_g")), "group"),
        F.when(F.col("gold_policy").isNotNull() & (F.col("gold_policy") != F.col("_p")), "policy"),
        F.when((F.size(v) != layers) | F.exists(v, lambda x: F.size(x) != width), "shape"),
        F.when(F.exists(v, lambda x: F.exists(x, odd)), "not finite"),
    )
    each = _said(both.withColumn("_bad", bad).where("_bad <> ''"), "artifact", key, F.col("_bad"))
    return unique(rows, keys).unionByName(coverage(source, rows, keys)).unionByName(each)


def overlap(counts: DataFrame) -> DataFrame:
    """overlap_counts of a source and a target: no common value of any key."""
    return _said(counts.where("common > 0"), "overlap", F.col("name"), F.col("common"))


def families(rows: DataFrame, group: str, level: str, rows_wanted: int, families_wanted: int, levels: list[int]) -> DataFrame:
    """So many rows in so many families, every family with each level once."""
    sizes = rows.agg(F.count("*").alias("r"), F.countDistinct(group).alias("f")).where((F.col("r") != rows_wanted) | (F.col("f") != families_wanted))
    return _said(sizes, "families", F.lit("all"), F.concat_ws("/", "r", "f")).unionByName(complete_levels(rows, group, level, levels))


def judgments(generations: DataFrame, records: DataFrame, benchmark: DataFrame) -> DataFrame:
    """generations (sample_id, generated_text) once each and all in the benchmark; records (sample_id, kind,
    memory_id, status, judge_result, generation_sha256) of generations, made from the text that is there, and
    without two valid ones of one key that differ."""
    strange = generations.select("sample_id").join(benchmark, "sample_id", "left_anti")
    lost = records.select("sample_id").distinct().join(generations, "sample_id", "left_anti")
    other = records.join(generations, "sample_id").where(~F.sha2("generated_text", 256).eqNullSafe(F.col("generation_sha256")))
    valid = records.where("status = 'ok'").groupBy("sample_id", "kind", "memory_id").agg(F.countDistinct("judge_result").alias("n")).where("n > 1")
    key = F.concat_ws("::", "sample_id", "kind", "memory_id")
    return (
        unique(generations, ["sample_id"])
        .unionByName(_said(strange, "not in the benchmark", F.col("sample_id"), F.lit("")))
        .unionByName(_said(lost, "not generated", F.col("sample_id"), F.lit("")))
        .unionByName(_said(other, "other text", key, F.col("generation_sha256")))
        .unionByName(_said(valid, "conflict", key, F.col("n")))
    )


def prompts(rows: DataFrame, key: str, rendered: str, native: str, spans: Column, memories: Column) -> DataFrame:
    """Rendered prompts that aren't the native ones, and memories without a span (spans, memories: arrays of ids)."""
    changed = _said(rows.where(~F.col(rendered).eqNullSafe(F.col(native))), "prompt", F.col(key), F.lit(""))
    gone = rows.withColumn("_gone", F.sort_array(F.array_except(memories, spans))).where(F.size("_gone") > 0)
    return changed.unionByName(_said(gone, "span", F.col(key), F.array_join("_gone", ",")))


def disjoint(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys (projects, say) in more than one split."""
    found = rows.groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1")
    return _said(found, "overlap", F.col(key), F.col("n"))


def kept_inputs(now: DataFrame, before: DataFrame, expected: int | None = None) -> DataFrame:
    """Files (path, bytes) that are gone, or shorter than they were; more files than expected."""
    old = before.select("path", F.col("bytes").alias("_b"))
    both = old.join(now, "path", "left")
    found = _said(both.where("bytes is null"), "replaced", F.col("path"), F.lit("")).unionByName(_said(both.where("bytes < _b"), "truncated", F.col("path"), F.col("bytes")))
    if expected is not None:
        found = found.unionByName(_said(now.agg(F.count("*").alias("n")).where(F.col("n") > expected), "too many", F.lit("all"), F.col("n")))
    return found


def require(violations: DataFrame) -> None:
    first = violations.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r['constraint']} {r['key']} {r['detail']}" for r in first))

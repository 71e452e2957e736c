"""Coverage, quality and agreement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(flag: Column) -> Column:
    """Mean of a boolean; null for none."""
    return F.avg(flag.cast("int"))


def policy_distribution(memories: DataFrame, by: list[str]) -> DataFrame:
    return memories.groupBy(*by, "policy").agg(F.count("*").alias("n"))


def subset_scores(rows: DataFrame) -> DataFrame:
    """Macro and slot-weighted micro scores over overlapping subsets. rows: (full_match, matched, slots,
    n_memories, all_ignore). A missing slots counts as 1; micro is null without slots."""
    tags = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("n_memories") == 1, "single"),
            F.when(F.col("n_memories") > 1, "multi"),
            F.when(F.col("all_ignore"), "all_ignore"),
            F.when((F.col("n_memories") > 1) & ~F.col("all_ignore"), "mixed"),
        )
    )
    slots = F.coalesce(F.col("slots"), F.lit(1))
    return rows.withColumn("subset", F.explode(tags)).groupBy("subset").agg(
        F.count("*").alias("n"), share(F.col("full_match")).alias("macro"), (F.sum("matched") / F.nullif(F.sum(slots), F.lit(0))).alias("micro")
    )


def follow_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Follow rate where a preference applies, where it doesn't, and the mean rating."""
    return rows.groupBy(*by).agg(
        F.avg(F.when(F.col("applies"), F.col("followed").cast("int"))).alias("adherence"),
        F.avg(F.when(~F.col("applies"), F.col("followed").cast("int"))).alias("misuse"),
        F.avg("rating").alias("completeness"),
    )


def ordinal_error(score: Column, gold: Column) -> Column:
    return F.avg(F.abs(score - gold))


def coverage(generated: DataFrame, required: DataFrame, valid: DataFrame, sample: str = "sample_id", key: str = "key") -> DataFrame:
    """Samples whose required keys all have a valid judgment: one row (sample, complete)."""
    matched = required.join(valid.select(key).distinct().withColumn("ok", F.lit(1)), key, "left")
    done = matched.groupBy(sample).agg(F.every(F.col("ok").isNotNull()).alias("complete"))
    return generated.select(sample).distinct().join(done, sample, "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def coverage_summary(done: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("generated"), F.count_if("complete").alias("valid"), F.count_if(~F.col("complete")).alias("missing"))


def incomplete(done: DataFrame, sample: str = "sample_id") -> DataFrame:
    """The samples that aren't complete, one row each."""
    return done.where(~F.col("complete")).select(sample)


def generation_quality(rows: DataFrame, by: list[str], text: str, repeated: Column) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(repeated).alias("repeated"), share(repeated).alias("repeated_rate"), F.avg(F.length(text)).alias("mean_chars")
    )


def band(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least and most over resamples."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def label_counts(rows: DataFrame, by: list[str], label: str, labels: list[str]) -> DataFrame:
    return rows.groupBy(*by).pivot(label, labels).agg(F.count(F.lit(1))).na.fill(0)


def group_collapse(rows: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """One row per group: its labels in order and the distinct ones."""
    return rows.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order, label))), lambda x: x[label]).alias("labels"),
        F.sort_array(F.collect_set(label)).alias("label_set"), F.count("*").alias("n"),
    )

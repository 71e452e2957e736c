"""Queries that write whole tables in the forms the readers know, and read them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import arrays, io
from ..sources.shared import folder
from .base import LONG, SIG, query, r6, table
from .metrics import HELD, held

CUSTOMER = "c_custkey long, c_name string, c_acctbal double"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "lines")
    io.write_json(customers(spark, sf_dir), path)
    return io.read_json(spark, path, CUSTOMER)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_gzip_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "gzip")
    customers(spark, sf_dir).write.option("compression", "gzip").json(path)
    return io.read_json(spark, path, CUSTOMER)


@query("SELECT s_suppkey, s_name FROM supplier")
def json_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "array")
    arrays.write_array(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").repartition(3, "s_suppkey"), path)
    return io.read_json(spark, path, "s_suppkey long, s_name string")


@query("SELECT DISTINCT concat(o_custkey, '::', o_orderstatus) AS uid FROM orders WHERE o_orderkey%10 <> 0 AND o_orderkey%11 <> 0")
def tolerant_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.concat(F.lit('{"uid": "'), F.concat_ws("::", "o_custkey", "o_orderstatus"), F.when(k % 10 == 0, F.lit("")).otherwise(F.lit('"}')))
    path = folder(spark, "done")
    table(spark, sf_dir, "orders").select(F.when(k % 11 == 0, "").otherwise(line).alias("value")).write.text(path)
    return io.read_done(spark, path)


def journal_lines(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("event_id")
    whole = F.to_json(F.struct(k.cast("string").alias("key"), F.lit("ok").alias("status"), F.col("value").alias("time")))
    line = F.when(k % 6 == 0, F.concat(F.lit('{"key": "'), k.cast("string"))).when(k % 5 == 0, F.lit('{"_journal_recovery": true}')).when(k % 13 == 0, "").otherwise(whole)
    path = folder(spark, "journal")
    table(spark, sf_dir, "events").select(k.alias("k"), line.alias("value")).repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.text(path)
    return path


@query("SELECT CAST(event_id AS VARCHAR) AS key, value AS time FROM events WHERE event_id%6<>0 AND event_id%5<>0 AND event_id%13<>0 AND event_id%7<>0")
def journal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = journal_lines(spark, sf_dir)
    lines = io.numbered_lines(spark, path)
    named = F.try_variant_get(F.try_parse_json("value"), "$.key", "long")
    skipped = lines.where(named % 7 == 0).select("file", "line")
    return io.read_journal(spark, path, skipped).select("key", "time")


@query("SELECT CAST(event_id AS VARCHAR) AS key, value AS time FROM events")
def strict_journal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal whose files each end in a torn line is read strictly; torn_lines names just these lines."""
    path = folder(spark, "torn")

    def torn(batches):
        for b in batches:
            yield b
        yield pa.RecordBatch.from_arrays([pa.array(['{"key": "torn'])], names=["value"])

    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct(k.cast("string").alias("key"), F.lit("ok").alias("status"), F.col("value").alias("time"))).alias("value")).repartition(3)
    rows.mapInArrow(torn, "value string").write.text(path)
    named = io.torn_lines(spark, path)
    if named.count() != spark.read.text(path).select("_metadata.file_path").distinct().count():
        raise RuntimeError("another number of torn lines")
    return io.read_journal(spark, path, named, strict=True).select("key", "time")


@query("SELECT printf('bench_kind_%04d', i-1) AS sample_id, s_name AS question FROM (SELECT s_name, s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) WHERE s_suppkey%2=0")
def benchmark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("question"), "s_suppkey")
    path = folder(spark, "benchmark")
    arrays.write_array(rows.repartitionByRange(3, "s_suppkey").sortWithinPartitions("s_suppkey"), path, "kind")
    got = io.read_benchmark(spark, path, "struct<question:string,s_suppkey:long>", "kind", prefix="bench_")
    kept = got.where("s_suppkey % 2 = 0").select("sample_id")
    return io.read_benchmark(spark, path, "struct<question:string,s_suppkey:long>", "kind", kept, "bench_").select("sample_id", "question")


@query("SELECT n_nationkey AS level, CASE WHEN n_nationkey%3=0 THEN 'fallback' ELSE n_name END AS first FROM nation")
def instruction_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    own = n.where(k % 6 != 0).select(k.alias("level"), F.array(F.lit(" "), F.when(k % 3 == 0, "").otherwise(F.col("n_name"))).alias("instructions"))
    pool = io.instruction_pool(own, n.select(k.alias("level"), F.array(F.lit("fallback")).alias("instructions")))
    return pool.select("level", F.get("instructions", F.lit(0)).alias("first"))


@query("SELECT concat(o_custkey, '::', o_orderkey) AS uid, CASE WHEN o_orderkey%2=0 THEN 'nested' ELSE 'flat' END AS policy FROM orders")
def merged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderkey").cast("string").alias("memory_id"))
    nested = o.where("memory_id % 2 = 0").groupBy("sample_id").agg(F.collect_list(F.struct("memory_id", F.lit("nested").alias("policy"))).alias("predictions"))
    return io.read_predictions(o.withColumn("policy", F.lit("flat")), nested).select("uid", "policy")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey%2=0")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = folder(spark, "appended"), customers(spark, sf_dir)
    io.append_json(c, path)
    io.append_json(c.where("c_custkey % 2 = 0"), path)
    return io.read_json(spark, path, CUSTOMER)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = folder(spark, "once"), customers(spark, sf_dir)
    io.write_once(c, path, spark)
    if io.write_once(c.repartition(3), path, spark):
        raise RuntimeError("equal rows were written twice")
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey%2=0")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = folder(spark, "replaced"), customers(spark, sf_dir)
    io.publish(c, path, spark)
    before = io.read_published(spark, path)
    io.publish(c.where("c_custkey % 2 = 0"), path, spark)
    # a plan made before still finds the old version
    return io.read_published(spark, path).join(before, c.columns, "left_semi")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def cached_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "cache")
    for _ in range(2):
        out = io.cached(spark, path, {"table": "customer"}, lambda: customers(spark, sf_dir))
    return out


@query("SELECT c_custkey, CASE WHEN c_custkey%2=0 THEN 'first' ELSE 'second' END AS run FROM customer")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = folder(spark, "resume"), customers(spark, sf_dir).select("c_custkey")
    for run, todo in (("first", c.where("c_custkey % 2 = 0")), ("second", c)):
        out = io.resume(todo, spark, path, "c_custkey", lambda t, r=run: t.withColumn("run", F.lit(r)), {"table": "customer"})
    return out


@query(f"""WITH {SIG}, {LONG}, {HELD} SELECT vec_id, string_agg(CAST(prediction AS VARCHAR), ',' ORDER BY layer) AS predictions FROM p GROUP BY 1""")
def layer_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "layers")
    io.write_json(io.predictions_by_layer(held(spark, sf_dir)), path)
    got = io.read_json(spark, path, "vec_id long, predictions array<long>")
    return got.select("vec_id", F.array_join(F.col("predictions").cast("array<string>"), ",").alias("predictions"))


@query("""SELECT concat('{"c_mktsegment":"', c_mktsegment, '","n":', count(*), ',"protocol":"v1"}') AS report FROM customer GROUP BY c_mktsegment""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return df.select(io.report(df, protocol="v1").alias("report"))


@query(f"""WITH {SIG}, {LONG}, {HELD}, c AS (SELECT vec_id%4 AS resample, layer, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY ALL), z AS (SELECT resample, layer, avg(r) AS z FROM c GROUP BY ALL) SELECT layer, round(avg(z),6) AS mean, round(min(z),6) AS least, round(max(z),6) AS most FROM z GROUP BY 1""")
def stability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = held(spark, sf_dir).withColumn("resample", F.col("vec_id") % 4)
    return io.curve_tables(p, ["layer", "resample"])["stability"].select("layer", *[r6(F.col(c)).alias(c) for c in ("mean", "least", "most")])

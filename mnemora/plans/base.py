"""Registration, and the views of the driver's tables that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LAYERS, WIDTH, RES = 4, 16, 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def exploded(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row per element: keys, dim, x (rounded)."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).select(*keys, F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory items: a labelled document is a memory of the sample (source, lang)."""
    policy = F.when(F.col("quality") == 0, "ignore").when(F.col("toxic") == 1, "support").otherwise("dominate")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.concat_ws("::", "source", "lang").alias("sample_id"), F.col("doc_id").alias("memory_id"), "source", "lang", "text",
        F.length("text").cast("long").alias("n"), policy.alias("policy"), "quality", "toxic",
    )


def memory_rows(spark: SparkSession, sf_dir: str, *more: str | Column) -> DataFrame:
    """sample_id, memory_id and more: the memories of samples as rows, for what would grow with the square of a sample."""
    return items(spark, sf_dir).select("sample_id", F.col("memory_id").cast("string").alias("memory_id"), *more)


ITEMS = """items AS (SELECT concat(d.source,'::',d.lang) AS sample_id, d.doc_id AS memory_id, d.source, d.lang, d.text,
 length(d.text) AS n, CASE WHEN l.quality=0 THEN 'ignore' WHEN l.toxic=1 THEN 'support' ELSE 'dominate' END AS policy, l.quality, l.toxic
 FROM documents d JOIN labels l USING (doc_id))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified nested records over items; memories in order of document."""
    from ..operators import records as R

    m = R.memory(F.col("memory_id"), F.col("text"), F.col("policy"))
    nested = items(spark, sf_dir).groupBy("sample_id", "source", "lang").agg(F.sort_array(F.collect_list(F.struct(F.col("memory_id").alias("o"), m.alias("m")))).alias("x"))
    nested = nested.withColumn("memories", F.transform("x", lambda x: x["m"]))
    return nested.select(
        "source", "sample_id", F.concat(F.lit("about "), F.col("lang")).alias("query"), F.col("source").alias("context"), "memories",
        F.create_map(F.lit("query_id"), F.col("sample_id")).alias("metadata"),
    )


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, layer, cls, regime, grp, v: embeddings as LAYERS vectors of WIDTH."""
    e = table(spark, sf_dir, "embeddings").withColumn("e", V.vec("embedding"))
    long = e.select("vec_id", (F.col("label") % 3).cast("long").alias("cls"), (F.col("vec_id") % 2).alias("regime"), (F.col("vec_id") % 25).alias("grp"), F.posexplode(V.blocks(F.col("e"), LAYERS, WIDTH)).alias("layer", "v"))
    return long.withColumn("layer", F.col("layer").cast("long"))


SIG = f"""sig AS (SELECT e.vec_id, l.layer, CAST(e.label % 3 AS BIGINT) AS cls, e.vec_id % 2 AS regime, e.vec_id % 25 AS grp,
 CAST(e.embedding AS DOUBLE[])[CAST({WIDTH}*l.layer+1 AS BIGINT):CAST({WIDTH}*l.layer+{WIDTH} AS BIGINT)] AS v
 FROM embeddings e, (SELECT unnest(range({LAYERS})) AS layer) l)"""
LONG = f"long AS (SELECT vec_id, layer, cls, regime, grp, unnest(v) AS x, unnest(range({WIDTH})) AS dim FROM sig)"


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, full, w0, w1 (whole embeddings, RES wide), c0, c1: three embeddings as [full, without 0, without 1]."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).cast("long").alias("k"), (F.col("vec_id") % 3).alias("j"), V.vec("embedding").alias("v"))
    part = lambda j: F.max(F.when(F.col("j") == j, F.col("v")))
    r = e.groupBy("k").agg(part(0).alias("full"), part(1).alias("w0"), part(2).alias("w1")).where("w1 is not null")
    return r.withColumn("c0", (F.col("k") % 3 - 1).cast("double")).withColumn("c1", ((F.col("k") + 1) % 3 - 1).cast("double"))


RESID = f"""r AS (SELECT * FROM (SELECT vec_id // 3 AS k, max(CASE WHEN vec_id%3=0 THEN CAST(embedding AS DOUBLE[]) END) AS f,
 max(CASE WHEN vec_id%3=1 THEN CAST(embedding AS DOUBLE[]) END) AS w0, max(CASE WHEN vec_id%3=2 THEN CAST(embedding AS DOUBLE[]) END) AS w1,
 CAST((vec_id//3)%3-1 AS DOUBLE) AS c0, CAST(((vec_id//3)+1)%3-1 AS DOUBLE) AS c1 FROM embeddings GROUP BY vec_id // 3) WHERE w1 IS NOT NULL)"""
LONGR = f"""rl AS (SELECT k, c0, c1, unnest(f) AS f, unnest(w0) AS w0, unnest(w1) AS w1, unnest(range({RES})) AS dim FROM r)"""

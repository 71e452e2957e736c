"""Queries over prompts: rendered layouts, judge prompts, intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rendering
from ..functions import text as T
from ..operators import records as R
from ..operators import unify as U
from .base import query, table

TEMPLATE = "Given {persona} answer: {question}"


def asked(spark: SparkSession, sf_dir: str, second: float = 1.0) -> DataFrame:
    """Customers as samples: odd ones have two memories, the second one with a coefficient."""
    m = lambda i, text, c: F.struct(F.lit(i).alias("memory_id"), text.alias("memory_text"), F.lit("dominate").alias("gold_policy"), F.lit(c).alias("c"))
    k = F.col("c_custkey")
    both = F.array(m("a", F.col("c_name"), 1.0), m("b", F.col("c_mktsegment"), second))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("sample_id"), F.lit("").alias("context"), F.concat(F.lit("q"), k.cast("string")).alias("query"), F.slice(both, F.lit(1), (1 + k % 2).cast("int")).alias("memories"))


@query("""SELECT c_custkey AS k, i AS stream, CASE WHEN c_custkey%2=0 THEN concat('Given ', CASE WHEN i=0 THEN c_name ELSE '' END, ' answer: q', c_custkey) ELSE concat('Given ', CASE i WHEN 0 THEN concat('[''', c_name, ''', ''', c_mktsegment, ''']') WHEN 1 THEN concat('[''', c_mktsegment, ''']') ELSE concat('[''', c_name, ''']') END, ' answer: q', c_custkey) END AS prompt FROM customer, (SELECT unnest(range(3)) AS i) WHERE i < 3 - (c_custkey%2=0)::INT""")
def official_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.render_layout(asked(spark, sf_dir), "leave_one_out", U.official_renderer(TEMPLATE))
    return out.select(F.col("sample_id").cast("long").alias("k"), F.col("stream").cast("long").alias("stream"), "prompt")


@query("""WITH l AS (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey%2=0 THEN [('grouped', 0, 'clean', c_name), ('grouped', 1, 'clean_without', ''), ('policy_grouped', 0, 'full', c_name), ('policy_grouped', 1, 'without_positive', '')]
 ELSE [('grouped', 0, 'clean', concat('[''', c_name, ''']')), ('grouped', 1, 'clean_without', '[]'), ('policy_grouped', 0, 'full', concat('[''', c_name, ''', ''', c_mktsegment, ''']')), ('policy_grouped', 1, 'without_negative', concat('[''', c_name, ''']')), ('policy_grouped', 2, 'without_positive', concat('[''', c_mktsegment, ''']'))] END) AS x FROM customer)
 SELECT k, x[1] AS layout, CAST(x[2] AS BIGINT) AS stream, x[3] AS kind, concat('Given ', x[4], ' answer: q', k) AS prompt FROM l""")
def grouped_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped layouts rendered in SQL by the table function."""
    rendering.register(spark)

    def one(layout: str) -> DataFrame:
        return spark.sql(
            f"SELECT sample_id, '{layout}' AS layout, stream, kind, prompt FROM rendered(TABLE(SELECT * FROM {{samples}}), layout => '{layout}', style => 'official', template => :template)",
            args={"template": TEMPLATE}, samples=asked(spark, sf_dir, -1.0),
        )

    return one("grouped").unionByName(one("policy_grouped")).select(F.col("sample_id").cast("long").alias("k"), "layout", F.col("stream").cast("long").alias("stream"), "kind", "prompt")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""SELECT s_suppkey AS k, sha256(replace({quoted(T.DEPENDENCE_SYSTEM)}, '{{rubric}}', s_name)) AS system,
 sha256(replace(replace(replace(replace({quoted(T.DEPENDENCE_USER)}, '{{task}}', CAST(s_suppkey AS VARCHAR)), '{{context}}', s_name), '{{query}}', CAST(s_nationkey AS VARCHAR)), '{{answer}}', concat('<think>', s_name, '</think>'))) AS said,
 sha256(replace(replace({quoted(T.COMPLETENESS)}, '{{task}}', s_name), '{{response}}', CAST(s_nationkey AS VARCHAR))) AS completeness FROM supplier""")
def dependence_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, n = F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey").cast("string")
    said = T.filled(T.DEPENDENCE_USER, task=k, context=name, query=n, answer=F.concat(F.lit("<think>"), name, F.lit("</think>")))
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), F.sha2(T.filled(T.DEPENDENCE_SYSTEM, rubric=name), 256).alias("system"), F.sha2(said, 256).alias("said"), F.sha2(T.filled(T.COMPLETENESS, task=name, response=n), 256).alias("completeness")
    )


@query("""SELECT event_id, CASE event_id%6 WHEN 0 THEN '忽略偏好' WHEN 1 THEN '支持性偏好' WHEN 2 THEN '支持性偏好' WHEN 3 THEN '以偏好为主线' WHEN 4 THEN '以偏好为主线' ELSE event_type END AS intent FROM events""")
def intent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ignore", "support", "supportive", "dominate", "dominant")))
    label = F.coalesce(F.get(names, (F.col("event_id") % 6).cast("int")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", R.intent(label).alias("intent"))

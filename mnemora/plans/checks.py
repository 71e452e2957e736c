"""Queries over constraints, prompts, stream layouts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import compose as C
from ..operators import gates as G
from ..operators import journal as L
from ..operators import readout as O
from ..operators import records as R
from ..operators import relational as J
from ..operators import unify as U
from ..operators import validate as X
from .base import ITEMS, LONG, LONGR, RES, RESID, SIG, items, memory_rows, query, r6, residuals, samples, signatures, table
from .metrics import HELD, LOGO, held

COEFFICIENT = "CASE policy WHEN 'ignore' THEN -1 WHEN 'support' THEN 0 ELSE 1 END"


def counted(violations: DataFrame) -> DataFrame:
    return violations.groupBy("constraint", "detail").agg(F.count("*").alias("n"))


@query("""SELECT 'digest' AS "constraint", count(*) AS n FROM documents WHERE doc_id%10=0""")
def digest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"), "doc_id")
    manifest = d.select("name", F.when(F.col("doc_id") % 10 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return X.digests(d, manifest).groupBy("constraint").agg(F.count("*").alias("n"))


@query("""SELECT 'order' AS "constraint", CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey%20=0 THEN CAST(c_custkey AS VARCHAR) ELSE concat(c_custkey+1, '/', c_custkey) END AS detail FROM customer WHERE c_custkey%10=0""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("k"), k.alias("p"))
    found = c.where("p % 20 <> 0").select("k", F.when(F.col("p") % 10 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("p"))
    return X.order(found, c, "k", "p")


@query("""WITH g AS (SELECT o_custkey AS g, CASE o_orderstatus WHEN 'F' THEN 'calibration' WHEN 'O' THEN 'heldout' ELSE 'other' END AS s FROM orders),
 v AS (SELECT 'conflict' AS c, CAST(count(DISTINCT s) AS VARCHAR) AS d FROM g GROUP BY g HAVING count(DISTINCT s)>1 UNION ALL SELECT 'calibration_share', 'over' FROM (SELECT count(DISTINCT g) FILTER (WHERE s='calibration')*1.0/count(DISTINCT g) AS x FROM g) WHERE x>0.2 UNION ALL SELECT DISTINCT 'split', concat(g, s) FROM g WHERE s='other')
 SELECT c AS "constraint", CASE c WHEN 'split' THEN 'other' ELSE d END AS detail, count(*) AS n FROM v GROUP BY ALL""")
def calibration_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("o_orderstatus") == "F", "calibration").when(F.col("o_orderstatus") == "O", "heldout").otherwise("other")
    found = X.calibration(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), split.alias("s")), "g", "s")
    return counted(found.withColumn("detail", F.when(F.col("constraint") == "calibration_share", "over").otherwise(F.col("detail"))))


@query("""WITH g AS (SELECT o_orderkey AS id, o_custkey AS g, CASE WHEN o_custkey%7=0 THEN 'calibration' ELSE 'heldout' END AS s FROM orders UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_custkey%7=0 THEN 'calibration' ELSE 'heldout' END FROM orders WHERE o_orderkey%89=0),
 c AS (SELECT o_orderkey AS id FROM orders WHERE (o_custkey%7=0 AND o_orderkey%101<>0) OR o_orderkey%103=0 UNION SELECT -o_orderkey FROM orders WHERE o_orderkey%97=0)
 SELECT 'duplicate_sample' AS "constraint", count(*) AS n FROM (SELECT id FROM g GROUP BY 1 HAVING count(*)>1) HAVING count(*)>0 UNION ALL SELECT 'missing_calibration', count(*) FROM c WHERE id NOT IN (SELECT id FROM g) HAVING count(*)>0
 UNION ALL SELECT 'not_chosen', count(DISTINCT id) FROM g WHERE s='calibration' AND id NOT IN (SELECT id FROM c) HAVING count(*)>0 UNION ALL SELECT 'not_in_calibration', count(DISTINCT id) FROM g WHERE s<>'calibration' AND id IN (SELECT id FROM c) HAVING count(*)>0""")
def calibration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    g = o.select(k.alias("id"), c.alias("g"), F.when(c % 7 == 0, "calibration").otherwise("heldout").alias("s"))
    chosen = o.where(((c % 7 == 0) & (k % 101 != 0)) | (k % 103 == 0)).select(k.alias("id")).union(o.where(k % 97 == 0).select(-k))
    return X.calibration(g.union(g.where("id % 89 = 0")), "g", "s", 0.2, "id", chosen).groupBy("constraint").agg(F.count("*").alias("n"))


@query("""SELECT 'overlap' AS "constraint", count(*) AS n FROM customer WHERE c_custkey%2=0 AND c_custkey%3=0 UNION ALL SELECT 'missing', count(*) FROM customer WHERE c_custkey%2<>0 AND c_custkey%3<>0""")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return X.splits(c.where("k % 2 = 0"), c.where("k % 3 = 0"), c, "k").groupBy("constraint").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT vec_id AS i, vec_id%7=0 AS g, vec_id%5=0 AS p, vec_id%11=0 AS s FROM embeddings WHERE vec_id%13<>0)
 SELECT 'artifact' AS "constraint", concat_ws(',', CASE WHEN g THEN 'group' END, CASE WHEN p THEN 'policy' END, CASE WHEN s THEN 'shape' END) AS detail, count(*) AS n FROM r WHERE g OR p OR s GROUP BY ALL UNION ALL SELECT 'missing', '', count(*) FROM embeddings WHERE vec_id%13=0""")
def artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    key = [F.lit("s").alias("sample_id"), i.cast("string").alias("memory_id")]
    source = e.select(*key, F.lit("g").alias("group_id"), F.lit("p").alias("gold_policy"))
    layers = F.when(i % 11 == 0, V.blocks(V.vec("embedding"), 3, 16)).otherwise(V.blocks(V.vec("embedding"), 4, 16))
    rows = e.where("vec_id % 13 <> 0").select(*key, F.when(i % 7 == 0, "x").otherwise("g").alias("group_id"), F.when(i % 5 == 0, "x").otherwise("p").alias("gold_policy"), layers.alias("v"))
    return counted(X.artifact(rows, source, "v", 4, 16))


@query("""SELECT 'levels' AS "constraint", string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS detail FROM lineitem GROUP BY l_orderkey HAVING string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber)<>'1,2,3,4' UNION ALL SELECT 'families', concat(count(*), '/', count(DISTINCT l_orderkey)) FROM lineitem""")
def family_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return X.families(l, "l_orderkey", "l_linenumber", 100, 20, [1, 2, 3, 4]).select("constraint", "detail")


@query(f"""WITH {ITEMS}, g AS (SELECT sample_id, list(DISTINCT policy) AS x FROM items GROUP BY 1) SELECT sample_id AS key, array_to_string(list_sort(list_filter(['ignore','support','dominate'], lambda p: NOT list_contains(x, p))), ',') AS detail FROM g WHERE len(x) < 3""")
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.label_cover(items(spark, sf_dir), "sample_id", "policy", ["ignore", "support", "dominate"]).select("key", "detail")


@query("""WITH g AS (SELECT conv_id AS s, max(text) AS t FROM conversations WHERE conv_id%9<>0 GROUP BY 1), r AS (SELECT conv_id AS s, turn, role, CASE WHEN turn%2=0 THEN 'ok' ELSE 'error' END AS status FROM conversations)
 SELECT 'not generated' AS "constraint", count(DISTINCT s) AS n FROM r WHERE s%9=0 UNION ALL SELECT 'other text', count(*) FROM r WHERE s%9<>0 AND s%4=0
 UNION ALL SELECT 'conflict', count(*) FROM (SELECT s, role FROM r WHERE status='ok' GROUP BY ALL HAVING count(DISTINCT turn)>1) UNION ALL SELECT 'not in the benchmark', count(*) FROM g WHERE s%10=0""")
def judgment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("sample_id", F.col("conv_id"))
    text = c.groupBy("sample_id").agg(F.max("text").alias("generated_text"))
    records = c.join(text, "sample_id").select(
        "sample_id", F.col("role").alias("kind"), F.lit("").alias("memory_id"), F.when(F.col("turn") % 2 == 0, "ok").otherwise("error").alias("status"), F.col("turn").cast("string").alias("judge_result"),
        F.when(F.col("sample_id") % 4 == 0, "?").otherwise(F.sha2("generated_text", 256)).alias("generation_sha256"),
    )
    found = X.judgments(text.where("sample_id % 9 <> 0"), records, text.where("sample_id % 10 <> 0").select("sample_id"))
    return found.groupBy("constraint").agg(F.count("*").alias("n"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey%3=0 THEN 'h' ELSE '' END || CASE WHEN s_suppkey%3=0 AND s_suppkey%2=0 THEN ',' ELSE '' END || CASE WHEN s_suppkey%2=0 THEN 'p' ELSE '' END AS detail FROM supplier WHERE s_suppkey%3=0 OR s_suppkey%2=0""")
def resume_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    now = table(spark, sf_dir, "supplier").select(k.cast("string").alias("k"), F.md5("s_name").alias("h"), F.sha2("s_name", 256).alias("p"), k.alias("i"))
    before = now.select("k", F.when(F.col("i") % 3 == 0, "").otherwise(F.col("h")).alias("h"), F.when(F.col("i") % 2 != 0, F.col("p")).alias("p"))
    return X.unchanged(now.drop("i"), before, "k", ["h", "p"]).select("key", "detail")


@query("""SELECT CAST(doc_id AS VARCHAR) AS key, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x = string_split(text, chr(10))[1])) AS VARCHAR) AS detail FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: x = string_split(text, chr(10))[1])) <> 1""")
def line_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("line", F.substring_index("text", "\n", 1))
    return X.single_line(d, "doc_id", "text", "line").select("key", "detail")


@query(f"""WITH {ITEMS}, n AS (SELECT sample_id, count(*) AS m, min(memory_id) AS a FROM items GROUP BY 1) SELECT 'prompt' AS "constraint", sample_id AS key, '' AS detail FROM n WHERE m%2=0 UNION ALL SELECT 'span', sample_id, CAST(a AS VARCHAR) FROM n WHERE m%3=0""")
def prompt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("m", F.size("memories")).withColumn("ids", F.transform("memories", lambda m: m["memory_id"]))
    rows = s.withColumn("rendered", F.col("query")).withColumn("native", F.when(F.col("m") % 2 == 0, F.lit("?")).otherwise(F.col("query")))
    spans = F.when(F.col("m") % 3 == 0, F.slice("ids", F.lit(2), F.size("ids"))).otherwise(F.col("ids"))
    return X.prompts(rows, "sample_id", "rendered", "native", spans, F.col("ids"))


@query("""SELECT 'replaced' AS "constraint", count(*) AS n FROM part WHERE p_partkey%10=0 UNION ALL SELECT 'truncated', count(*) FROM part WHERE p_partkey%10<>0 AND p_partkey%7=0 AND p_size>0 UNION ALL SELECT 'too many', 1""")
def input_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("long").alias("bytes"), "p_partkey")
    now = p.where("p_partkey % 10 <> 0").select("path", F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(F.col("bytes")).cast("long").alias("bytes"))
    return X.kept_inputs(now, p.select("path", "bytes"), 3).groupBy("constraint").agg(F.count("*").alias("n"))


@query("""SELECT 'overlap' AS "constraint", lang AS key, CAST(count(DISTINCT doc_id%2) AS VARCHAR) AS detail FROM documents GROUP BY lang HAVING count(DISTINCT doc_id%2)>1""")
def project_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.disjoint(table(spark, sf_dir, "documents").withColumn("split", F.col("doc_id") % 2), "lang", "split")


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY sha256(concat('rq1-reference|13|',c_nationkey)), c_nationkey) AS rank FROM (SELECT DISTINCT c_nationkey FROM customer)), s AS (SELECT c_nationkey, CASE WHEN rank <= (SELECT floor(count(*)*0.5) FROM p) THEN 'extraction' ELSE 'evaluation' END AS split FROM p)
 SELECT split, count(*) AS customers, count(DISTINCT c_nationkey) AS projects FROM customer JOIN s USING (c_nationkey) GROUP BY 1""")
def project_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.project_split(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 0.5, 13)
    return s.groupBy("split").agg(F.count("*").alias("customers"), F.countDistinct("c_nationkey").alias("projects"))


@query("""SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 20""")
def head_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.head_per(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 20)


@query("""SELECT c_custkey AS k, CAST(16*(c_custkey%80+1)//36 AS BIGINT) AS first, CAST(greatest(16*(c_custkey%80+1)//36+1, 24*(c_custkey%80+1)//36) AS BIGINT) AS stop FROM customer""")
def layer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, stop = R.layer_window(F.col("c_custkey") % 80 + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), first.cast("long").alias("first"), stop.cast("long").alias("stop"))


@query("""SELECT printf('single_%04d', s_suppkey) AS sample_id, concat(printf('single_%04d', s_suppkey), '_m0') AS memory_id, s_name AS memory_text, CASE s_suppkey%3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'support' ELSE 'dominate' END AS gold_policy, concat('about ', s_suppkey) AS context FROM supplier""")
def unify_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(
        k.alias("pos"), F.lit("q").alias("question"), F.col("s_name").alias("persona"), F.concat(F.lit("about "), k.cast("string")).alias("implicit_persona"),
        F.element_at(F.array(F.lit("忽略偏好"), F.lit("支持性偏好"), F.lit("以偏好为主线")), (k % 3 + 1).cast("int")).alias("intent_type"), F.lit("i").alias("intent"), F.lit(None).cast("string").alias("reason"),
    )
    u = U.from_single(raw, "supplier", "single")
    return R.items(u).join(u.select("sample_id", "context"), "sample_id").select("sample_id", "memory_id", "memory_text", "gold_policy", "context")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS sample_id, 'history' AS memory_id, p_name AS memory_text, CASE p_partkey%5+1 WHEN 1 THEN 'ignore' WHEN 5 THEN 'dominate' ELSE 'support' END AS gold_policy, CAST(p_partkey%5+1 AS DOUBLE) AS gold_score FROM part""")
def unify_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.lit("q").alias("query"), F.col("p_name").alias("history"), (F.col("p_partkey") % 5 + 1).alias("level"))
    return R.items(U.from_levels(raw, "part")).select("sample_id", "memory_id", "memory_text", "gold_policy", "gold_score")


@query(f"""WITH {ITEMS}, n AS (SELECT sample_id, count(*) AS m FROM items GROUP BY 1) SELECT sample_id, CAST(memory_id AS VARCHAR) AS memory_id, sample_id AS group_id, CASE WHEN m=1 THEN 'single' ELSE 'multi' END AS regime, CASE policy WHEN 'dominate' THEN 'apply' ELSE 'not_apply' END AS label, policy AS original_policy FROM items JOIN n USING (sample_id)""")
def native_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.native_records(samples(spark, sf_dir), {"ignore": "not_apply", "support": "not_apply", "dominate": "apply"})


@query(f"""WITH {ITEMS} SELECT concat(sample_id,'::',memory_id) AS uid, lang AS group_id, concat('about ', lang) AS query_key, CASE WHEN lang < 'f' THEN 'calibration' ELSE 'heldout' END AS split FROM items""")
def keyed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("query", F.concat(F.lit("  "), F.upper("query"), F.lit(" ")))
    group = F.lower(F.substring_index(F.trim("query"), " ", -1))
    return R.keyed_items(s, group, s.select(group.alias("group_id")).where("group_id < 'f'")).select("uid", "group_id", "query_key", "split")


def layout_sql(layout: str) -> str:
    """Prompts of a layout per sample: how many, and how many memories they keep in all."""
    counts = {
        "leave_one_out": ("1+m", "m+m*(m-1)"),
        "isolated": ("1+2*m", "m+m"),
        "joint_isolated": ("1+2*m", "m-neg+m"),
        "hybrid": ("1+3*m", "m+m+m*(m-1)"),
        "policy_grouped": ("1+(neg>0)::INT+(pos>0)::INT", "m+CASE WHEN neg>0 THEN m-neg ELSE 0 END+CASE WHEN pos>0 THEN m-pos ELSE 0 END"),
        "policy_ordered": ("1+(neg>0)::INT+(pos>0)::INT", "m+CASE WHEN neg>0 THEN m-neg ELSE 0 END+CASE WHEN pos>0 THEN m-neg-pos ELSE 0 END"),
        "grouped": ("1+pos", "m-neg+pos*(m-neg-1)"),
    }
    n, kept = counts[layout]
    return f"SELECT '{layout}' AS layout, sample_id, CAST({n} AS BIGINT) AS prompts, CAST({kept} AS BIGINT) AS kept FROM w"


@query(f"""WITH {ITEMS}, w AS (SELECT sample_id, count(*) AS m, count(*) FILTER (WHERE policy='ignore') AS neg, count(*) FILTER (WHERE policy='dominate') AS pos FROM items GROUP BY 1) {' UNION ALL '.join(map(layout_sql, R.LAYOUTS))}""")
def stream_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory_rows(spark, sf_dir, R.coefficient(F.lit(None).cast("double"), F.col("policy")).alias("c"))
    return R.layout_streams(m).groupBy("layout", "sample_id").agg(F.count("*").alias("prompts"), F.sum("kept").alias("kept"))


@query("""SELECT s_suppkey AS k, sha256(concat('You are given:\n1) A single preference attribute.\n2) One response written for a given context.\n\nYour task is to judge whether the response follows the preference.\n\nIf the response follows the preference, label it as "follow". Otherwise, label it as "do_not_follow".\n\nPreference:\n', s_name, '\n\nResponse:\n', '{preference} ', s_suppkey, '\n\nOnly output a JSON object:\n{"label": "follow" | "do_not_follow"}')) AS preference,
 length(s_name) AS chars, s_suppkey%4 > 1 AS multi FROM supplier""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    answer = F.concat(F.lit("{preference} "), k.cast("string"))
    done = T.filled(T.COMPLETENESS, task=F.col("s_name"), response=answer)
    return s.select(
        k.alias("k"), F.sha2(T.filled(T.PREFERENCE, preference=F.col("s_name"), response=answer), 256).alias("preference"),
        (F.length(done) - F.length(F.lit(T.COMPLETENESS)) + len("{task}") + len("{response}") - F.length(answer)).cast("long").alias("chars"),
        T.judge_schema(F.when(k % 4 == 0, 1).otherwise(k % 4)).contains("n/").alias("multi"),
    )


@query("""SELECT event_id, CASE WHEN event_id%3=0 THEN concat('u', event_id) ELSE CAST(event_id AS VARCHAR) END AS id FROM events""")
def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    own = F.when(i % 3 != 0, i.cast("string")).otherwise(F.when(i % 2 == 0, F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", T.sample_key(own, F.concat(F.lit("u"), i.cast("string"))).alias("id"))


@query("""SELECT event_id, CAST(event_id%7 + 20 - event_id%11 AS BIGINT) AS first, CAST(event_id%7 + 3 + 20 - event_id%11 AS BIGINT) AS last FROM events""")
def shifted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    p = G.shifted(F.array(i % 7, i % 7 + 1, i % 7 + 3), F.lit(20), i % 11)
    return table(spark, sf_dir, "events").select("event_id", F.array_min(p).cast("long").alias("first"), F.array_max(p).cast("long").alias("last"))


@query("""WITH lg AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) * 12 AS x, unnest(list_reverse(CAST(embedding AS DOUBLE[]))) AS d FROM embeddings), a AS (SELECT vec_id, ln(sum(exp(x))) AS z, ln(sum(exp(x+2*d))) AS y FROM lg GROUP BY 1),
 k AS (SELECT vec_id, round(least(greatest(sum(exp(x-z)*((x-z)-(x+2*d-y))),0.0),2.0),6)+0.0 AS gate FROM lg JOIN a USING (vec_id) GROUP BY 1)
 SELECT vec_id, c AS condition, CASE WHEN c LIKE '%dac%' THEN gate WHEN c LIKE '%no_gate' THEN 1.0::DOUBLE ELSE (vec_id%5)/2.0::DOUBLE END AS gate FROM k, (SELECT unnest(['dynamic_gate','dynamic_no_gate','fixed_gate','fixed_no_gate','dac_full_vocab','fixed_dac_full_vocab']) AS c)""")
def condition_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import logits

    e = logits(spark, sf_dir).withColumn("a", (F.col("vec_id") % 5) / F.lit(2.0))
    gates = F.array(*[F.struct(F.lit(n).alias("condition"), r6(G.condition_gate(n, F.col("a"), F.col("l"), F.col("d"))).alias("gate")) for n in G.CONDITIONS])
    return e.select("vec_id", F.explode(gates).alias("x")).select("vec_id", "x.*")


HYBRID = "greatest(sum((f-{a})*(f-{b}))/greatest(sqrt(sum((f-{a})*(f-{a})))*sqrt(sum((f-{b})*(f-{b}))),1e-12),0)*0.5 AS g{i}, sqrt(sum((f-{a})*(f-{a})))/greatest(sqrt(sum((f-{b})*(f-{b}))),1e-12) AS s{i}"


@query(f"""WITH {RESID}, {LONGR}, a AS (SELECT k, {HYBRID.format(a='w0', b='w1', i=0)}, {HYBRID.format(a='w1', b='w0', i=1)} FROM rl GROUP BY k), h AS (SELECT rl.k, dim, c0, c1, c0*((f-w0)*(1-g0)+(f-w1)*s0*g0) AS x, c1*((f-w1)*(1-g1)+(f-w0)*s1*g1) AS y FROM rl JOIN a USING (k))
 SELECT k, CAST(dim AS BIGINT) AS dim, round(x+y,6)+0.0 AS total, round((CASE WHEN c0>0 THEN x ELSE 0 END+CASE WHEN c1>0 THEN y ELSE 0 END)/greatest((c0>0)::INT+(c1>0)::INT,1)+(CASE WHEN c0<0 THEN x ELSE 0 END+CASE WHEN c1<0 THEN y ELSE 0 END)/greatest((c0<0)::INT+(c1<0)::INT,1),6)+0.0 AS by_sign FROM h""")
def hybrid_over_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residuals(spark, sf_dir)
    d0, d1 = V.sub(F.col("full"), F.col("w0")), V.sub(F.col("full"), F.col("w1"))
    args = (F.array("c0", "c1"), F.array(d0, d1), F.array(d1, d0), RES)
    both = r.select("k", F.arrays_zip(C.hybrid_transport(*args).alias("a"), C.hybrid_transport(*args, mean_by_sign=True).alias("b")).alias("x"))
    return both.select("k", F.posexplode("x").alias("dim", "x")).select("k", F.col("dim").cast("long").alias("dim"), r6(F.col("x.a")).alias("total"), r6(F.col("x.b")).alias("by_sign"))


@query(f"""WITH {SIG}, {LONG}, {HELD} SELECT layer, cls, count(*) AS n, round(avg(CASE WHEN prediction=cls THEN 1 ELSE 0 END),6) AS recall FROM p GROUP BY ALL""")
def class_recall_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.class_recalls(held(spark, sf_dir), ["layer"]).select("layer", "cls", "n", r6(F.col("recall")).alias("recall"))


@query(f"""WITH {SIG}, {LONG}, {HELD} SELECT layer, round(avg(abs(prediction-cls)),6) AS level_mae FROM p GROUP BY layer""")
def level_error_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.class_metrics(held(spark, sf_dir), ["layer"], ordinal=True).select("layer", r6(F.col("level_mae")).alias("level_mae"))


@query(f"""WITH a AS (WITH {SIG}, {LONG}, {LOGO}, c AS (SELECT layer, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY ALL) SELECT layer, avg(r) AS mr FROM c GROUP BY 1),
 b AS (WITH {SIG}, {LONG}, {HELD}, c AS (SELECT layer, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n, sum(CASE WHEN prediction=cls THEN 1 ELSE 0 END) AS h FROM p GROUP BY ALL) SELECT layer, avg(r) AS mr, sum(h)*1.0/sum(n) AS acc FROM c GROUP BY 1)
 SELECT a.layer, round(a.mr,6) AS reference_macro_recall, round(b.mr,6) AS held_macro_recall, round(b.acc,6)::DOUBLE AS held_accuracy, (SELECT layer FROM b ORDER BY round(mr,9) DESC, layer LIMIT 1) AS peak_layer FROM a JOIN b USING (layer) ORDER BY round(a.mr,9) DESC, a.layer LIMIT 1""")
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = O.class_metrics(O.leave_group_out(signatures(spark, sf_dir).where("grp < 10")), ["layer"])
    out = O.layer_report(reference, O.class_metrics(held(spark, sf_dir), ["layer"]))
    return out.select("layer", *[r6(F.col(c)).alias(c) for c in ("reference_macro_recall", "held_macro_recall", "held_accuracy")], "peak_layer")


@query("""WITH j AS (SELECT user_id, event_type, bool_or(NOT (event_type='error' OR value<5)) AS ok FROM events GROUP BY ALL) SELECT event_type AS kind, count(*) AS expected, count(*) FILTER (WHERE ok) AS valid FROM j GROUP BY 1""")
def journal_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .relations import journal

    state = L.rollup(journal(spark, sf_dir), ["key"], "event_id", "status", "value")
    expected = table(spark, sf_dir, "events").select(F.concat_ws("::", "user_id", "event_type").alias("key"), F.col("event_type").alias("kind"))
    return L.valid_by_kind(state, expected, "key", "kind")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS endpoint, CASE WHEN s_suppkey%3=0 THEN 90.0::DOUBLE ELSE 30.0::DOUBLE END AS latency, CASE WHEN s_suppkey%3=0 THEN s_suppkey+300.0::DOUBLE ELSE 0.0::DOUBLE END AS until FROM supplier""")
def router_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return L.router_start(table(spark, sf_dir, "supplier").select(k.cast("string").alias("endpoint"), (k % 3 != 0).alias("reachable"), k.alias("at")))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey*8+l_linenumber AS p, o_custkey FROM lineitem JOIN orders ON o_orderkey=l_orderkey""")
def artifact_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p"))
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return J.aligned(rows, source, ["l_orderkey"], "p").select("l_orderkey", "l_linenumber", "p", "o_custkey")


@query("""SELECT c_custkey, i AS pos, CAST(c_custkey+i AS BIGINT) AS l, concat('v', i) AS r FROM customer, (SELECT unnest(range(3)) AS i) WHERE i < 2 + c_custkey%2""")
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    left, right = F.array(k, k + 1, k + 2), F.slice(F.array(F.lit("v0"), F.lit("v1"), F.lit("v2")), F.lit(1), (2 + k % 2).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(J.positional(left, right)).alias("pos", "x"))
    return c.select("c_custkey", F.col("pos").cast("long").alias("pos"), "x.l", "x.r")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN NULL WHEN o_orderkey%4=1 THEN CAST(o_orderkey%2 AS INT) ELSE CAST(o_orderkey%3 AS INT) END AS matched, CASE WHEN o_orderkey%4=0 THEN NULL ELSE 4.5::DOUBLE + least(o_orderkey%9,5) END AS total, CASE WHEN o_orderkey%4<>0 THEN concat('because ', o_orderkey) END AS reason FROM orders""")
def verdict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    metrics = F.concat(F.lit('"OPB": 1, "UPB": "0.5", "RII": true, "FM": 2, "VG": -3, "Judge": '), (k % 9).cast("string"))
    match = F.when(k % 4 == 1, F.concat(F.lit('"match": '), F.when(k % 2 == 1, "true").otherwise("false"))).otherwise(F.concat(F.lit('"full_match": false, "match": "'), (k % 3).cast("string"), F.lit('/3"')))
    reply = F.concat(F.lit("so ```json\n{"), F.when(k % 4 == 0, F.lit('"OPB": 1')).otherwise(F.concat(metrics, F.lit(", "), match, F.lit(', "reason": "because '), k.cast("string"), F.lit('"'))), F.lit("}\n```"))
    v = table(spark, sf_dir, "orders").select("o_orderkey", P.verdict(reply, F.when(k % 4 == 1, 1).otherwise(3)).alias("v"))
    return v.select("o_orderkey", "v.matched", F.aggregate(F.map_values("v.metrics"), F.lit(0.0), lambda s, x: s + x).alias("total"), "v.reason")


@query()
def repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import metrics as M

    d = table(spark, sf_dir, "documents").withColumn("r", T.repetition("text"))
    return M.generation_quality(d, ["lang"], "text", F.col("r.unit").isNotNull()).select("lang", "n", "repeated", r6(F.col("repeated_rate")).alias("repeated_rate"))

"""Joins, windows, ranks, set operations and constraints over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import journal as L
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators import relational as J
from ..operators import validate as C
from .base import ITEMS, items, query, r6, table


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue, round(avg(l_quantity),6) AS mean_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1,2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_quantity")).alias("mean_quantity"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(sum(o_totalprice),2) AS total FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1,2""")
def equi_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    j = c.join(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """WITH e AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), types AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events)
 SELECT l.user_id, count(*) AS pairs, CAST(sum(least(l.s+21600, r.s+43200)-greatest(l.s,r.s)) AS BIGINT) AS seconds FROM e l JOIN e r ON l.user_id=r.user_id AND l.s < r.s+43200 AND r.s < l.s+21600, types
 WHERE l.event_type=types.a AND r.event_type=types.b GROUP BY 1"""
)
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    l = e.join(F.broadcast(kinds), F.col("event_type") == F.col("a"), "left_semi").select("user_id", F.col("s").alias("l_start"), (F.col("s") + 21600).alias("l_end"))
    r = e.join(F.broadcast(kinds), F.col("event_type") == F.col("b"), "left_semi").select("user_id", F.col("s").alias("r_start"), (F.col("s") + 43200).alias("r_end"))
    o = J.overlap(l, r, ["user_id"], 43200)
    return o.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("seconds"))


@query("""SELECT c.conv_id, c.turn, c.role, f.turn AS said, length(c.text) AS chars FROM conversations c JOIN (SELECT conv_id, turn, sha256(text) AS h FROM conversations WHERE role='user') f ON f.conv_id=c.conv_id AND f.h=sha256(c.text)""")
def hash_residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = c.where("role = 'user'").select("conv_id", F.col("turn").alias("said"), F.sha2("text", 256).alias("h"))
    return J.matching_hash(c, said, "conv_id", "text", "h").select("conv_id", "turn", "role", "said", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {ITEMS}, g AS (SELECT DISTINCT sample_id FROM items) SELECT sample_id, row_number() OVER (ORDER BY sha256(concat('rq1-reference|42|',sample_id)), sample_id) AS rank FROM g""")
def hash_rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hash_rank(items(spark, sf_dir).select("sample_id").distinct(), "sample_id", 42)


@query(f"""WITH {ITEMS}, g AS (SELECT source, count(DISTINCT sample_id) AS total, count(*) AS n FROM items GROUP BY 1), t AS (SELECT source, n+20 AS total, n//3+4 AS single FROM g), c AS (SELECT *, least(greatest(round_even(total*0.2,0),6), total-6) AS cnt FROM t)
 SELECT source, CAST(least(greatest(round_even(cnt*single/total,0),3),cnt-3) AS BIGINT) AS allocated FROM c""")
def stratified_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = items(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", K.allocation(F.floor(F.col("n") / 3) + 4, F.col("n") + 20, 0.2).alias("allocated"))


@query(
    f"""WITH RECURSIVE {ITEMS}, h AS (SELECT sample_id, bool_or(policy='ignore')::INT AS i, bool_or(policy='support')::INT AS u, bool_or(policy='dominate')::INT AS d FROM items GROUP BY 1),
 g AS (SELECT *, row_number() OVER (ORDER BY sha256(concat('rq1-reference|42|',sample_id)), sample_id) AS rank FROM h),
 s AS (SELECT -1::BIGINT AS turn, []::VARCHAR[] AS chosen, 0 AS a, 0 AS b, 0 AS c UNION ALL
 SELECT turn+1, list_append(chosen, x.k), a+x.i, b+x.u, c+x.d FROM (SELECT s.turn, s.chosen, s.a, s.b, s.c, arg_max(struct_pack(k := g.sample_id, i := g.i, u := g.u, d := g.d), ((s.a<2)::BIGINT*g.i+(s.b<2)::BIGINT*g.u+(s.c<2)::BIGINT*g.d)*1000000000 - g.rank) AS x
 FROM s JOIN g ON NOT list_contains(s.chosen, g.sample_id) WHERE s.turn < 7 GROUP BY ALL))
 SELECT turn, chosen[len(chosen)] AS sample_id FROM s WHERE turn >= 0"""
)
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = items(spark, sf_dir).groupBy("sample_id").agg(F.sort_array(F.collect_set("policy")).alias("labels"))
    chosen = K.greedy_cover(K.hash_rank(g, "sample_id", 42), "sample_id", "labels", "rank", ["ignore", "support", "dominate"], 2, 8)
    return spark.createDataFrame([(i, k) for i, k in enumerate(chosen)], "turn long, sample_id string")


@query(
    f"""WITH {ITEMS}, g AS (SELECT sample_id, lang, count(*) AS n FROM items GROUP BY ALL), s AS (SELECT unnest(range(10)) AS i), r AS (SELECT i, lang, n, row_number() OVER (PARTITION BY i ORDER BY sha256(concat('rq1-reference|', CAST(42+1009*(i+1) AS VARCHAR), '|', sample_id)), sample_id) AS rk FROM g, s),
 v AS (SELECT i, lang, avg(n) AS v FROM r WHERE rk <= 20 GROUP BY ALL) SELECT lang, round(avg(v),6) AS mean, round(min(v),6) AS least, round(max(v),6) AS most FROM v GROUP BY 1"""
)
def resample_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = items(spark, sf_dir).groupBy("sample_id", "lang").agg(F.count("*").alias("n"))
    seeds = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    key = F.sha2(F.concat_ws("|", F.lit(K.SALT), (42 + 1009 * (F.col("i") + 1)).cast("string"), "sample_id"), 256)
    ranked = seeds.withColumn("rk", F.row_number().over(Window.partitionBy("i").orderBy(key, "sample_id"))).where("rk <= 20")
    b = M.band(ranked.groupBy("i", "lang").agg(F.avg("n").alias("v")), ["lang"], "v")
    return b.select("lang", *[r6(F.col(c)).alias(c) for c in ("mean", "least", "most")])


@query("""WITH j AS (SELECT user_id, event_type, event_id, CASE WHEN event_type='error' OR value<5 THEN 'error' ELSE 'ok' END AS status, value FROM events)
 SELECT concat(user_id,'::',event_type) AS key, arg_max(status,event_id) AS latest_status, round(arg_max(value,event_id) FILTER (WHERE status='ok'),6) AS valid_value, count(*) AS attempts, count(*) FILTER (WHERE status<>'ok') AS invalid FROM j GROUP BY 1""")
def journal_latest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rollup(journal(spark, sf_dir), ["key"], "event_id", "status", "value").withColumn("valid_value", r6(F.col("valid_value")))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = (F.col("event_type") == "error") | (F.col("value") < 5)
    return e.select(F.concat_ws("::", "user_id", "event_type").alias("key"), "event_id", F.when(bad, "error").otherwise("ok").alias("status"), "value")


@query("""WITH j AS (SELECT concat(user_id,'::',event_type) AS key, CASE WHEN event_type='error' OR value<5 THEN 'error' ELSE 'ok' END AS status FROM events),
 s AS (SELECT key, bool_or(status='ok') AS ok, count(*) FILTER (WHERE status<>'ok') AS invalid FROM j GROUP BY 1), x AS (SELECT DISTINCT concat(user_id,'::',t) AS key FROM events, (SELECT DISTINCT event_type AS t FROM events))
 SELECT count(*) AS expected, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT coalesce(ok,false)) AS open, CAST(sum(coalesce(invalid,0)) AS BIGINT) AS invalid_attempts, round(count(*) FILTER (WHERE ok)*1.0/count(*),6) AS coverage, count(*)=count(*) FILTER (WHERE ok) AS complete FROM x LEFT JOIN s USING (key)""")
def journal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.collect_set("event_type").alias("ts"))
    expected = e.select("user_id").distinct().join(F.broadcast(kinds)).select(F.explode("ts").alias("t"), "user_id").select(F.concat_ws("::", "user_id", "t").alias("key"))
    return L.summary(L.rollup(journal(spark, sf_dir), ["key"], "event_id", "status", "value"), expected, "key").withColumn("coverage", r6(F.col("coverage")))


@query("""SELECT user_id, round(list_reduce(list_prepend(30.0::DOUBLE, list(value ORDER BY event_id)), lambda a, x: a*0.8+x*0.2),6) AS latency, count(*) AS n FROM events GROUP BY 1""")
def ewma_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.ewma(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")
    return e.select("user_id", r6(F.col("latency")).alias("latency"), "n")


ROUTER = """e AS (SELECT CAST(user_id AS VARCHAR) AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value AS v, event_type='error' AS f, event_id AS o FROM events),
 s AS (SELECT DISTINCT u, 0::BIGINT AS i, 30.0::DOUBLE AS l, 0::BIGINT AS k, 0.0::DOUBLE AS t FROM e UNION ALL
 SELECT s.u, e.i, CASE WHEN e.f THEN greatest(90.0, s.l) ELSE 0.8*s.l+0.2*e.v END, CASE WHEN e.f THEN s.k+1 ELSE 0 END, CASE WHEN e.f THEN e.o+least(600.0, 60*power(2, least(s.k+1,3))) ELSE s.t END FROM s JOIN e ON e.u=s.u AND e.i=s.i+1)"""


@query(f"""WITH RECURSIVE {ROUTER} SELECT u AS user_id, round(arg_max(l,i),6) AS latency, CAST(max(i) AS INT) AS count, CAST(arg_max(k,i) AS INT) AS failures, arg_max(t,i) AS until FROM s GROUP BY 1""")
def router_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return L.router_replay(e.withColumn("user_id", F.col("user_id").cast("string")), "user_id", "event_id", "value", "failed").withColumn("latency", r6(F.col("latency")))


@query("""SELECT arg_min(s_name, (s_nationkey % 3 + 1) * (s_acctbal + 2000) / 4 * 1000000 + s_suppkey) AS endpoint FROM supplier WHERE s_suppkey % 2 = 0""")
def least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("endpoint"), (F.col("s_nationkey") % 3).alias("active"), (F.col("s_acctbal") + 2000).alias("latency"), F.lit(4).alias("cap"), F.col("s_suppkey").alias("count"),
        (F.col("s_suppkey") % 2).alias("cooldown"),
    )
    return K.least_loaded(s)


@query("""WITH x AS (SELECT CAST(list_transform([408, 200+(event_id%4)*100], lambda s: s) AS BIGINT[]) AS t, event_id, value FROM events)
 SELECT event_id, CASE WHEN event_id%2=0 THEN 1 ELSE 2 END::BIGINT AS attempts, (CASE WHEN event_id%2=0 THEN 0 ELSE 1 END + CASE WHEN 200+(event_id%4)*100>=500 THEN 1 ELSE 0 END)::BIGINT AS retryable, 200+(event_id%4)*100 AS last_status, round(CASE WHEN event_id%2=0 THEN value ELSE value+1.5 END,6) AS seconds FROM x""")
def transport_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.struct((200 + F.col("event_id") % 4 * 100).alias("status"), F.col("value").alias("seconds"))
    first = F.struct(F.lit(408).cast("long").alias("status"), F.lit(1.5).alias("seconds"))
    e = table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 2 == 0, F.array(last)).otherwise(F.array(first, last)))
    out = L.transport_attempts(e, "event_id", "t")
    return out.select("event_id", F.col("attempts").cast("long").alias("attempts"), F.col("retryable").cast("long").alias("retryable"), "last_status", r6(F.col("seconds")).alias("seconds"))


@query(
    r"""WITH d AS (SELECT DISTINCT trim(regexp_replace(lower(text),'\s+',' ','g')) AS t FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(lower(text),'\s+',' ','g')) AS t FROM benchmark),
 dp AS (SELECT DISTINCT sha256(t) AS t FROM d), bp AS (SELECT DISTINCT sha256(t) AS t FROM b)
 SELECT 'text' AS name, (SELECT count(*) FROM d) AS "left", (SELECT count(*) FROM b) AS "right", (SELECT count(*) FROM d JOIN b USING (t)) AS common
 UNION ALL SELECT 'digest', (SELECT count(*) FROM dp), (SELECT count(*) FROM bp), (SELECT count(*) FROM dp JOIN bp USING (t))
 UNION ALL SELECT 'sample_id', (SELECT count(DISTINCT doc_id) FROM documents), (SELECT count(DISTINCT item_id) FROM benchmark), (SELECT count(DISTINCT doc_id) FROM documents JOIN benchmark ON doc_id=item_id)
 UNION ALL SELECT 'group_id', (SELECT count(DISTINCT doc_id%97) FROM documents), (SELECT count(DISTINCT item_id%89) FROM benchmark), (SELECT count(DISTINCT doc_id%97) FROM documents WHERE doc_id%97 IN (SELECT item_id%89 FROM benchmark))"""
)
def normalize_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    d, b = (x.withColumn("t", T.normalize("text")) for x in (d, b))
    t, s = F.col("t"), lambda c: c.cast("string")
    keys = {"text": (t, t), "digest": (F.sha2(t, 256), F.sha2(t, 256)), "sample_id": (s(F.col("doc_id")), s(F.col("item_id"))), "group_id": (s(F.col("doc_id") % 97), s(F.col("item_id") % 89))}
    return J.overlap_counts(d, b, keys)


@query(r"""SELECT item_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS plain, true AS wide, true AS sharp FROM benchmark""")
def folded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fullwidth letters and white space, and sharp s for ss, have the key of the plain text."""
    signs = "".join(map(chr, range(33, 127)))
    wide = F.translate(F.replace("text", F.lit(" "), F.lit("\u3000")), signs, "".join(chr(ord(c) + 0xFEE0) for c in signs))
    sharp = F.upper(F.replace("text", F.lit("ss"), F.lit("ß")))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.normalize("text").alias("t"), T.normalize(wide).alias("w"), T.normalize(sharp).alias("s"))
    return b.select("item_id", F.sha2("t", 256).alias("plain"), (F.col("w") == F.col("t")).alias("wide"), (F.col("s") == F.col("t")).alias("sharp"))


@query()
def normalize_key_overlap_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(T.normalize("text").alias("t"))
    b = table(spark, sf_dir, "benchmark").select(T.normalize("text").alias("t"))
    return J.overlap_counts(d, b, {"text": (F.col("t"), F.col("t"))})


@query("""SELECT c_mktsegment, c_custkey, round(c_acctbal,2) AS c_acctbal, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank<=5""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal")), ["c_mktsegment"], "c_acctbal", ["c_custkey"], 5)


@query("""SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w,6) AS running, round(l_quantity - lag(l_quantity) OVER w,6) AS step FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def running_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", r6(F.sum("l_quantity").over(w)).alias("running"), r6(F.col("l_quantity") - F.lag("l_quantity").over(w)).alias("step"))


@query("""SELECT 'except' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(c.subtract(o), "except").unionByName(n(c.intersect(o), "intersect")).unionByName(n(c.union(o).distinct(), "union"))


@query("""SELECT count(*) FILTER (WHERE NOT o) AS missing, (count(*) FILTER (WHERE NOT o)=0 AND (SELECT count(*) FROM customer c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))>0) AS proper FROM (SELECT DISTINCT o_custkey, o_custkey IN (SELECT c_custkey FROM customer) AS o FROM orders)""")
def proper_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.is_proper_subset(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query(
    """WITH p AS (SELECT concat(o_custkey,'::',o_orderkey) AS uid, o_custkey AS sample_id, o_orderkey AS memory_id, CASE WHEN o_orderkey%50=0 THEN NULL ELSE o_totalprice END AS coefficient, CASE o_orderstatus WHEN 'F' THEN 'calibration' WHEN 'O' THEN 'heldout' ELSE 'other' END AS split FROM orders),
 v AS (SELECT 'prediction' AS c, concat_ws(',', CASE WHEN coefficient IS NULL THEN 'coefficient' END, CASE WHEN split='other' THEN 'split' END) AS d FROM p WHERE coefficient IS NULL OR split='other'
 UNION ALL SELECT 'one_split', CAST(count(DISTINCT split) AS VARCHAR) FROM p GROUP BY sample_id HAVING count(DISTINCT split)>1
 UNION ALL SELECT 'missing', '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT 'levels', string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FROM lineitem GROUP BY l_orderkey HAVING string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber)<>'1,2,3,4'
 UNION ALL SELECT 'unique', CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*)>1
 UNION ALL SELECT 'differs', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus)>1)
 SELECT c AS "constraint", d AS detail, count(*) AS n FROM v GROUP BY ALL"""
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, l = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    split = F.when(F.col("o_orderstatus") == "F", "calibration").when(F.col("o_orderstatus") == "O", "heldout").otherwise("other")
    p = o.select(
        F.concat_ws("::", "o_custkey", "o_orderkey").alias("uid"), F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderkey").cast("string").alias("memory_id"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("coefficient"), split.alias("split"),
    )
    found = (
        C.predictions(p)
        .unionByName(C.coverage(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), ["k"]))
        .unionByName(C.complete_levels(l.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber")), "l_orderkey", "l_linenumber", [1, 2, 3, 4]))
        .unionByName(C.unique(o, ["o_custkey", "o_orderpriority"]))
        .unionByName(C.same_in_group(o, "o_custkey", ["o_orderstatus"]))
    )
    return found.groupBy("constraint", "detail").agg(F.count("*").alias("n"))

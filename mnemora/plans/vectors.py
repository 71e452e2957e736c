"""Queries over counterfactual residuals, logits, gates and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import compose as C
from ..operators import gates as G
from .base import LONGR, RES, RESID, exploded, query, r6, residuals, table

_COEFFICIENTS = lambda: F.array("c0", "c1")
_WITHOUT = lambda: F.array("w0", "w1")


def deltas():
    return C.directions(_COEFFICIENTS(), F.col("full"), _WITHOUT())


def moved(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return exploded(residuals(spark, sf_dir).withColumn("y", make()), "y", "k")


def elementwise(expr: str) -> str:
    return f"WITH {RESID}, {LONGR} SELECT k, CAST(dim AS BIGINT) AS dim, round({expr},6)+0.0 AS x FROM rl"


def whole(more: str, expr: str) -> str:
    """SQL with per-row aggregates `more` over rl (columns of a) and an elementwise expression."""
    return f"WITH {RESID}, {LONGR}, a AS (SELECT k, {more} FROM rl GROUP BY k) SELECT rl.k, CAST(dim AS BIGINT) AS dim, round({expr},6)+0.0 AS x FROM rl JOIN a USING (k)"


@query(elementwise("f-w0"))
def pairwise_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: V.sub(F.col("full"), F.col("w0")))


@query(elementwise("c0*(f-w0)+c1*(f-w1)"))
def sum_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.transport_sum(deltas(), RES))


@query(elementwise("(CASE WHEN c0>0 THEN c0*(f-w0) ELSE 0 END + CASE WHEN c1>0 THEN c1*(f-w1) ELSE 0 END)/greatest((c0>0)::INT+(c1>0)::INT,1) + (CASE WHEN c0<0 THEN c0*(f-w0) ELSE 0 END + CASE WHEN c1<0 THEN c1*(f-w1) ELSE 0 END)/greatest((c0<0)::INT+(c1<0)::INT,1)"))
def signed_mean_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.signed_mean(deltas(), RES))


@query(elementwise("c0*(w0-f)+c1*(w1-f)"))
def isolated_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.transport_sum(C.isolated_directions(_COEFFICIENTS(), _WITHOUT(), F.array("full", "full")), RES))


@query(whole("greatest(sum((f-w0)*(f-w1))/greatest(sqrt(sum((f-w0)*(f-w0)))*sqrt(sum((f-w1)*(f-w1))),1e-12),0)*0.5 AS g, sqrt(sum((f-w0)*(f-w0)))/greatest(sqrt(sum((f-w1)*(f-w1))),1e-12) AS s", "((f-w0)*(1-g)+(f-w1)*s*g)*c0"))
def hybrid_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.hybrid(F.col("c0"), V.sub(F.col("full"), F.col("w0")), V.sub(F.col("full"), F.col("w1"))))


@query(elementwise("w0-f+(CASE WHEN c0>0 THEN c0*(f-w0) ELSE 0 END)+(CASE WHEN c1>0 THEN c1*(f-w1) ELSE 0 END)"))
def joint_isolated_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.joint_isolated(F.col("full"), F.col("w0"), deltas(), RES))


@query(elementwise("(f-w0)*((CASE WHEN c0>0 THEN c0 ELSE 0 END)+(CASE WHEN c1>0 THEN c1 ELSE 0 END))/greatest((c0>0)::INT+(c1>0)::INT,1)+(f-w1)*((CASE WHEN c0<0 THEN c0 ELSE 0 END)+(CASE WHEN c1<0 THEN c1 ELSE 0 END))/greatest((c0<0)::INT+(c1<0)::INT,1)"))
def policy_grouped_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.policy_grouped(F.col("full"), F.col("w0"), F.col("w1"), _COEFFICIENTS(), RES))


@query(elementwise("f+c0*(f-w0)+c1*(f-w1)"))
def grouped_clean_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.grouped_clean(F.col("full"), deltas(), RES))


@query(elementwise("(CASE WHEN abs(c0+1)<1e-8 THEN w0 ELSE f+c0*(f-w0) END)+c1*(w0-w1)"))
def ordered_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.policy_ordered(F.col("full"), F.col("w0"), F.col("w1"), F.col("c0"), F.col("c1")))


@query(whole("sqrt(sum((f-w0)*(f-w0))) AS l0, sqrt(sum((f-w1)*(f-w1))) AS l1, sum((f-w0)*(f-w1))/(sqrt(sum((f-w0)*(f-w0)))*sqrt(sum((f-w1)*(f-w1)))) AS g", "(c0*l0-g*c1*l1)/(1-g*g)*(f-w0)/l0+(c1*l1-g*c0*l0)/(1-g*g)*(f-w1)/l1"))
def gram_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residuals(spark, sf_dir).select("k", deltas().alias("deltas"))
    return exploded(C.gram(r, "k"), "moved", "k")


@query(whole("sqrt(sum(f*f)) AS a, sqrt(sum((f+c0*(f-w0))*(f+c0*(f-w0)))) AS b", "(f+c0*(f-w0))*(a/greatest(b,1e-12))"))
def radial_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.steer(F.col("full"), V.sub(F.col("full"), F.col("w0")), F.col("c0"), keep_norm=True))


@query(f"""WITH {RESID}, {LONGR}, a AS (SELECT k, sqrt(sum(f*f)) AS r, sum(f*w0) AS d FROM rl GROUP BY k), t AS (SELECT rl.*, a.r, w0-d/(greatest(r,1e-12)*greatest(r,1e-12))*f AS t FROM rl JOIN a USING (k)),
 n AS (SELECT k, sqrt(sum(t*t)) AS n FROM t GROUP BY k), o AS (SELECT t.*, n.n, least(n.n/greatest(r,1e-12), pi()/2) AS g FROM t JOIN n USING (k)) SELECT k, CAST(dim AS BIGINT) AS dim, round(CASE WHEN n<=1e-12 THEN f ELSE f*cos(g)+t*(r/greatest(n,1e-12))*sin(g) END,6)+0.0 AS x FROM o""")
def tangent_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: V.tangent_transport(F.col("full"), F.col("w0")))


@query(elementwise("f+c0*(f-w0)+c1*(f-w1)"))
def counterfactual_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.counterfactual_logits(F.col("full"), _WITHOUT(), _COEFFICIENTS(), RES))


@query(elementwise("w0+c0*(w0-f)+c1*(w0-w1)"))
def grouped_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir, lambda: C.grouped_logits(F.col("w0"), F.array("full", "w1"), _COEFFICIENTS(), RES))


@query(elementwise("f+(w0-w1)"))
def frozen_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda a, b: F.struct(F.col(a).alias("only"), F.col(b).alias("empty"))
    return moved(spark, sf_dir, lambda: F.element_at(C.frozen(F.array(step("w0", "w1"), step("w1", "full"))), 2))


@query(whole("sum(f*w0) AS p, sqrt(sum(w0*w0)) AS s", "f+w0*(0.5*(p-1.4*s)+least(greatest(-0.06*(p-0.5*s),-0.6),0.4))"))
def adaptive_steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = V.dot(F.col("full"), F.col("w0")), V.norm(F.col("w0"))
    return moved(spark, sf_dir, lambda: C.steer(F.col("full"), F.col("w0"), C.adaptive_alpha(p, s, 0.5, False) + C.adaptive_alpha(p, s, 0.5, True)))


@query(f"""WITH {RESID}, {LONGR} SELECT k, round(sum(w0*f)+0.5,6)+0.0 AS a, round(sum(w1*f)-0.5,6)+0.0 AS b FROM rl GROUP BY k""")
def linear_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.readout(F.col("full"), _WITHOUT(), F.array(F.lit(0.5), F.lit(-0.5)))
    r = residuals(spark, sf_dir).select("k", out.alias("o"))
    return r.select("k", r6(F.get("o", F.lit(0))).alias("a"), r6(F.get("o", F.lit(1))).alias("b"))


LOGITS = "lg AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) * 12 AS x, unnest(list_reverse(CAST(embedding AS DOUBLE[]))) AS d, unnest(range(64)) AS t FROM embeddings)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("e", V.vec("embedding"))
    return e.select("vec_id", V.scale(F.col("e"), 12.0).alias("l"), F.reverse("e").alias("d"))


@query(f"""WITH {LOGITS}, a AS (SELECT vec_id, ln(sum(exp(x))) AS z, ln(sum(exp(x+2*d))) AS y FROM lg GROUP BY 1) SELECT vec_id, round(least(greatest(sum(exp(x-z)*((x-z)-(x+2*d-y))),0.0),2.0),6)+0.0 AS gate FROM lg JOIN a USING (vec_id) GROUP BY 1""")
def kl_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", r6(G.kl_gate(F.col("l"), F.col("d"))).alias("gate"))


@query(f"""WITH {LOGITS}, a AS (SELECT vec_id, sum(exp(x)) AS z FROM lg GROUP BY 1), m AS (SELECT vec_id, z, sum(exp(x)/z*d) AS m FROM lg JOIN a USING (vec_id) GROUP BY ALL), v AS (SELECT vec_id, sum(exp(x)/z*(d-m)*(d-m)) AS v FROM lg JOIN m USING (vec_id) GROUP BY 1)
 SELECT vec_id, round(CASE WHEN v<=1e-8 THEN 1.0 ELSE least(greatest(sqrt(0.1/greatest(v,1e-8)),0.25),2.0) END,6)+0.0 AS gate FROM v""")
def fisher_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", r6(G.fisher_gate(F.col("l"), F.col("d"))).alias("gate"))


@query("""SELECT event_id, round(CASE WHEN m<=1e-8 THEN 1.0 ELSE 0.5+value/(value+m) END,6)+0.0 AS gate, round(CASE WHEN m<=1e-8 THEN 1.0 ELSE least(greatest(sqrt(value/greatest(m,1e-8)),0.25),4.0) END,6)+0.0 AS weight FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM events)""")
def bounded_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(G.bounded_attention(F.col("value"), ["user_id"])).alias("gate"), r6(G.normalized_attention(F.col("value"), ["user_id"])).alias("weight"))


@query("""SELECT event_id, round(CASE WHEN value+r<=1e-8 THEN 1.0 ELSE 0.5+value/greatest(value+r,1e-8) END,6)+0.0 AS attention, round(CASE WHEN value+r<=1e-8 THEN 1.0 ELSE 0.5+r/greatest(value+r,1e-8) END,6)+0.0 AS budget FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)""")
def temporal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(G.temporal(F.col("value"), ["user_id"], "event_id")).alias("attention"), r6(G.temporal(F.col("value"), ["user_id"], "event_id", True)).alias("budget"))


@query("""WITH h AS (SELECT vec_id, h, CAST(embedding AS DOUBLE[])[CAST(16*h+1 AS BIGINT):CAST(16*h+16 AS BIGINT)] AS v FROM embeddings, (SELECT unnest(range(4)) AS h)), l AS (SELECT vec_id, h, unnest(v) AS x, unnest(range(16)) AS p FROM h), s AS (SELECT *, exp(x)/sum(exp(x)) OVER (PARTITION BY vec_id,h) AS a FROM l)
 SELECT vec_id, round(coalesce(sum(a) FILTER (WHERE p < vec_id%5),0)/greatest(4*(vec_id%5),1),6)+0.0 AS mass FROM s GROUP BY vec_id""")
def attention_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.transform(V.blocks(V.vec("embedding"), 4, 16), V.softmax)
    positions = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda p: p < F.col("vec_id") % 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(G.attention_mass(heads, positions)).alias("mass"))


NUCLEUS = f"""{LOGITS}, p AS (SELECT vec_id, t, exp(x)/sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM lg), c AS (SELECT *, sum(p) OVER w - p AS before, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY round(p,12) DESC, t ROWS UNBOUNDED PRECEDING)), n AS (SELECT * FROM c WHERE before < 0.8 OR i=1)"""


@query(f"""WITH {NUCLEUS} SELECT vec_id, count(*) AS kept, round(sum(p),6) AS mass, CAST(max(t) AS BIGINT) AS last FROM n GROUP BY 1""")
def nucleus_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = logits(spark, sf_dir).select("vec_id", G.nucleus(F.col("l"), 0.8).alias("n"))
    return n.select("vec_id", F.size("n").cast("long").alias("kept"), r6(F.aggregate("n", F.lit(0.0), lambda s, x: s + x["p"])).alias("mass"), F.array_max(F.transform("n", lambda x: x["token"])).cast("long").alias("last"))


@query(f"""WITH {NUCLEUS}, z AS (SELECT vec_id, sum(p) AS z, max(i) AS m FROM n GROUP BY 1), f AS (SELECT n.vec_id, n.t, n.i, z.m, sum(p/z) OVER (PARTITION BY n.vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cdf FROM n JOIN z USING (vec_id))
 SELECT vec_id, CAST(arg_min(t, i) AS INT) AS token FROM f WHERE cdf >= ((vec_id*37)%101)/101.0::DOUBLE OR i=m GROUP BY 1""")
def inverse_cdf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = (F.col("vec_id") * 37 % 101) / F.lit(101.0)
    kept = logits(spark, sf_dir).select("vec_id", draw.alias("u"), G.nucleus(F.col("l"), 0.8).alias("n"))
    return kept.select("vec_id", G.sample(F.col("n"), F.col("u")).alias("token"))


@query(f"""WITH {LOGITS} SELECT vec_id, CAST(arg_max(t, x*1e6 - t/1e6) AS INT) AS token FROM lg GROUP BY 1""")
def greedy_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", G.greedy(F.col("l")).alias("token"))


@query("""WITH m AS (SELECT vec_id, list_transform(range(16), lambda i: CASE WHEN i >= vec_id%6 THEN 1 ELSE 0 END) AS m FROM embeddings) SELECT vec_id, CAST(unnest(range(16)) AS BIGINT) AS i, CAST(unnest(list_transform(range(16), lambda i: CASE WHEN i >= vec_id%6 THEN i - vec_id%6 ELSE 0 END)) AS BIGINT) AS position, CAST(15 - vec_id%6 AS BIGINT) AS last FROM m""")
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i >= F.col("vec_id") % 6, 1).otherwise(0))
    e = table(spark, sf_dir, "embeddings").select("vec_id", mask.alias("m"))
    return e.select("vec_id", V.last_position(F.col("m")).cast("long").alias("last"), F.posexplode(V.position_ids(F.col("m"))).alias("i", "position")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("position").cast("long").alias("position"), "last")


@query("""SELECT vec_id, label % 3 AS policy, round(sum(x) OVER (PARTITION BY vec_id % 10 ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),6)+0.0 AS moving FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)""")
def moving_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.col("vec_id") % 10).orderBy("vec_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("policy"), r6(F.sum(F.get(V.vec("embedding"), F.lit(0))).over(w)).alias("moving"))


@query(elementwise("(f+(w0-f)*(1+k%2))"))
def attention_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = (1 + F.col("k") % 2).cast("double")
    return moved(spark, sf_dir, lambda: G.attention_state(F.col("w0"), F.col("full"), F.col("c0"), gate, F.lit(1.0), "extract")[0])


@query(f"""WITH {RESID}, {LONGR}, c AS (SELECT unnest(['extract', 'steer', 'both', 'neither']) AS control) SELECT k, control, CAST(dim AS BIGINT) AS dim,
 round((CASE WHEN control IN ('extract', 'both') THEN f+(w0-f)*(1+k%2) ELSE w0 END)*c0*(CASE WHEN control IN ('steer', 'both') THEN 0.5 ELSE 1 END),6)+0.0 AS x FROM rl, c""")
def attention_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = (1 + F.col("k") % 2).cast("double")

    def one(control: str):
        only, coefficient = G.attention_state(F.col("w0"), F.col("full"), F.col("c0"), gate, F.lit(0.5), control)
        return F.struct(F.lit(control).alias("control"), V.scale(only, coefficient).alias("y"))

    r = residuals(spark, sf_dir).select("k", F.explode(F.array(*map(one, ("extract", "steer", "both", "neither")))).alias("z")).select("k", "z.*")
    return exploded(r, "y", "k", "control")


DIGITS = "list_transform(range(1, 9), lambda i: CAST(ascii(substr(md5({}), CAST(i AS INT), 1)) AS DOUBLE))"


@query(f"""WITH v AS (SELECT c_custkey AS k, {DIGITS.format("concat(c_mktsegment, ' ', c_name)")} AS a, {DIGITS.format("c_mktsegment")} AS b FROM customer), l AS (SELECT k, unnest(a) AS a, unnest(b) AS b, unnest(range(8)) AS dim FROM v)
 SELECT k, CAST(dim AS BIGINT) AS dim, round(a-b,6)+0.0 AS x FROM l""")
def shared_empty_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's prompt less the prompt of the segment alone, which all customers of a segment share and which is computed once."""
    digits = lambda p: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.ascii(F.substring(F.md5(p), i, F.lit(1))).cast("double"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("only"), F.col("c_mktsegment").alias("empty"))
    return exploded(C.isolated_differences(rows, lambda d: d.select("digest", digits(F.col("prompt")).alias("v"))), "delta", "k")


@query("""SELECT vec_id, CAST(CASE WHEN vec_id%3=0 THEN 31 ELSE 3+(vec_id%4)*2 END AS INT) AS layer FROM embeddings""")
def measured_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == 3 + F.col("vec_id") % 4 * 2, "full_attention").otherwise("linear"))
    from ..operators import records as R

    layer = R.last_full_layer(F.when(F.col("vec_id") % 3 != 0, kinds), F.lit(32))
    return table(spark, sf_dir, "embeddings").select("vec_id", layer.cast("int").alias("layer"))

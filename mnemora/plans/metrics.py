"""Queries over activation readouts: centroids, layer choice, neighbours, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import readout as O
from .base import LAYERS, LONG, SIG, WIDTH, exploded, query, r6, signatures, table


def readout_sql(folds: str, train: str, asked: str) -> str:
    """Predictions p(fold, vec_id, layer, regime, cls, prediction); train and asked are conditions."""
    return f"""f AS ({folds}),
 center AS (SELECT fold, layer, dim, avg(x) AS c FROM long, f WHERE {train} GROUP BY ALL),
 cent AS (SELECT fold, l.vec_id, l.layer, l.cls, l.regime, l.grp, l.dim, l.x-c.c AS x FROM long l JOIN center c USING (layer, dim)),
 nrm AS (SELECT fold, vec_id, layer, greatest(sqrt(sum(x*x)),1e-12) AS n FROM cent GROUP BY ALL),
 u AS (SELECT cent.*, cent.x/nrm.n AS u FROM cent JOIN nrm USING (fold, vec_id, layer)),
 m AS (SELECT fold, layer, regime, cls, dim, avg(u) AS m FROM u WHERE {train} GROUP BY ALL),
 mn AS (SELECT fold, layer, regime, cls, greatest(sqrt(sum(m*m)),1e-12) AS n FROM m GROUP BY ALL),
 k AS (SELECT m.fold, m.layer, m.regime, m.cls, m.dim, m.m/mn.n AS k FROM m JOIN mn USING (fold, layer, regime, cls)),
 s AS (SELECT u.fold, u.vec_id, u.layer, u.regime, u.cls, k.cls AS cand, round(sum(u.u*k.k),9) AS s FROM u JOIN k ON u.fold=k.fold AND u.layer=k.layer AND u.regime=k.regime AND u.dim=k.dim WHERE {asked} GROUP BY ALL),
 p AS (SELECT fold, vec_id, layer, regime, cls, cand AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY fold, vec_id, layer ORDER BY s DESC, cand) AS rn FROM s) WHERE rn=1)"""


HELD = readout_sql("SELECT 0 AS fold", "grp < 10", "u.grp >= 10")
LOGO = readout_sql("SELECT DISTINCT grp AS fold FROM long WHERE grp < 10", "grp < 10 AND grp <> fold", "u.grp = u.fold")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signatures(spark, sf_dir)
    return O.predict(s.where("grp >= 10"), s.where("grp < 10"), ["layer"], "vec_id")


@query(f"""WITH {SIG}, {LONG}, {HELD}, c AS (SELECT layer, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n, sum(CASE WHEN prediction=cls THEN 1 ELSE 0 END) AS h FROM p GROUP BY ALL)
 SELECT layer, CAST(sum(n) AS BIGINT) AS n, round(sum(h)*1.0/sum(n),6)::DOUBLE AS accuracy, round(avg(r),6) AS macro_recall, count(*) AS classes FROM c GROUP BY layer""")
def layer_macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.class_metrics(held(spark, sf_dir), ["layer"]).select("layer", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("macro_recall")).alias("macro_recall"), "classes")


@query(f"""WITH {SIG}, {LONG}, {HELD}, q AS (SELECT layer, NULL::BIGINT AS regime, cls, prediction FROM p UNION ALL SELECT layer, regime, cls, prediction FROM p),
 c AS (SELECT layer, regime, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n, sum(CASE WHEN prediction=cls THEN 1 ELSE 0 END) AS h FROM q GROUP BY ALL)
 SELECT layer, regime, CAST(sum(n) AS BIGINT) AS n, round(sum(h)*1.0/sum(n),6)::DOUBLE AS accuracy, round(avg(r),6) AS macro_recall, count(*) AS classes FROM c GROUP BY layer, regime""")
def class_metrics_by_layer_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = O.sliced_metrics(held(spark, sf_dir))
    return m.select("layer", "regime", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("macro_recall")).alias("macro_recall"), "classes")


@query(f"""WITH {SIG}, {LONG}, {LOGO}, c AS (SELECT layer, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY ALL), mr AS (SELECT layer, round(avg(r),6) AS macro_recall FROM c GROUP BY 1)
 SELECT layer, macro_recall, row_number() OVER (ORDER BY macro_recall DESC, layer)=1 AS selected FROM mr""")
def logo_layer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = O.leave_group_out(signatures(spark, sf_dir).where("grp < 10"))
    m = O.class_metrics(p, ["layer"]).select("layer", r6(F.col("macro_recall")).alias("macro_recall"))
    best = m.agg(F.min_by("layer", F.struct(-F.col("macro_recall"), F.col("layer"))).alias("best"))
    return m.join(F.broadcast(best)).select("layer", "macro_recall", (F.col("layer") == F.col("best")).alias("selected"))


@query(f"""WITH {SIG}, long0 AS (SELECT vec_id, layer, cls, regime, grp, unnest(v) AS x, unnest(list_reverse(v)) AS y, unnest(range({WIDTH})) AS dim FROM sig),
 long AS (SELECT vec_id*2 AS vec_id, layer, cls, regime, grp, dim, x FROM long0 UNION ALL SELECT vec_id*2+1, layer, cls, regime, grp+100, dim, x+0.25*y FROM long0 WHERE regime=1),
 {readout_sql("SELECT 0 AS fold", "grp < 10", "u.regime=1 AND (u.grp BETWEEN 10 AND 99 OR u.grp>=110)")}, c AS (SELECT layer, vec_id%2 AS o, cls, avg(CASE WHEN prediction=cls THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM p GROUP BY ALL)
 SELECT layer, CASE o WHEN 0 THEN 'joint' ELSE 'isolated' END AS origin, CAST(sum(n) AS BIGINT) AS n, round(avg(r),6) AS macro_recall FROM c GROUP BY ALL""")
def paired_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signatures(spark, sf_dir).withColumn("origin", F.lit("joint"))
    isolated = s.where("regime = 1").withColumn("v", V.axpy(0.25, F.reverse("v"), F.col("v"))).withColumn("origin", F.lit("isolated"))
    asked = s.where("regime = 1").unionByName(isolated).where("grp >= 10")
    p = O.predict(asked, s.where("grp < 10").drop("origin"), ["layer"], "vec_id")
    return O.class_metrics(p, ["layer", "origin"]).select("layer", "origin", "n", r6(F.col("macro_recall")).alias("macro_recall"))


@query(f"""WITH {SIG}, {LONG}, {HELD} SELECT layer, regime, cls, CAST(dim AS BIGINT) AS dim, round(k,6)+0.0 AS x FROM k""")
def centroid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = O.centroids(signatures(spark, sf_dir).where("grp < 10"), ["layer"])
    return exploded(c, "centroid", "layer", "regime", "cls")


@query(f"""WITH {SIG}, q AS (SELECT vec_id, grp, list(v ORDER BY layer) AS vs FROM sig GROUP BY ALL), n AS (SELECT vec_id, grp, list_transform(vs, lambda v: list_transform(v, lambda x: x/greatest(sqrt(list_sum(list_transform(v, lambda y: y*y))),1e-6))) AS vs FROM q),
 r AS (SELECT * FROM n WHERE grp<10), s AS (SELECT a.vec_id, b.vec_id AS ref, b.grp AS rgrp, CAST(b.vec_id%3-1 AS DOUBLE) AS value, round(list_dot_product(flatten(a.vs), flatten(b.vs))/{LAYERS},9) AS sim FROM n a JOIN r b ON a.grp<>b.grp AND a.vec_id%7<>b.vec_id%7),
 o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, rgrp ORDER BY sim DESC, ref) AS a FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref) AS b FROM o WHERE a=1),
 w AS (SELECT vec_id, value, exp((sim-max(sim) OVER (PARTITION BY vec_id))/0.1) AS w FROM t WHERE b<=3) SELECT vec_id, round(sum(w*value)/sum(w),6)+0.0 AS value, count(*) AS effective_k FROM w GROUP BY 1""")
def knn_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") % 25).alias("grp"), (F.col("vec_id") % 7).alias("query_key"), V.blocks(V.vec("embedding"), LAYERS, WIDTH).alias("layers"), (F.col("vec_id") % 3 - 1).cast("double").alias("value")
    )
    n = O.nearest(e, e.where("grp < 10"), 3, 0.1)
    return n.select("vec_id", r6(F.col("value")).alias("value"), "effective_k")

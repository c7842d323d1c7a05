"""Vector queries bound to the ``embeddings`` table.

Class vectors are the per-label centroids of the table itself (the closed
label set of a zero-shot run); every item is scored against all classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions.vectors import l2_norm
from scorecraft.operators import metrics as M
from scorecraft.operators import nearest as N
from scorecraft.plans.evaluate import classify_features
from scorecraft.plans.registry import register, table
from scorecraft.sources.sinks import feature_file_name

LOGIT_SCALE = 100.0

_SIMS_SQL = """
ev AS (SELECT vec_id, label, CAST(x AS DOUBLE) AS x, pos
       FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
cent AS (SELECT label AS class_idx, pos, avg(x) AS c FROM ev GROUP BY ALL),
cn AS (SELECT class_idx, sqrt(sum(c * c)) AS cnorm FROM cent GROUP BY ALL),
vn AS (SELECT vec_id, label, sqrt(sum(x * x)) AS vnorm FROM ev GROUP BY ALL),
dots AS (SELECT ev.vec_id, cent.class_idx, sum(ev.x * cent.c) AS dot FROM ev JOIN cent USING (pos) GROUP BY ALL),
sims AS (SELECT d.vec_id, vn.label, d.class_idx, d.dot / (vn.vnorm * cn.cnorm) AS sim
         FROM dots d JOIN vn USING (vec_id) JOIN cn USING (class_idx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class_idx) AS rn
                        FROM sims) WHERE rn = 1)"""


def _classes(emb: DataFrame) -> DataFrame:
    cent = N.class_centroids(emb, "label", "embedding")
    return cent.select(F.col("label").alias("class_idx"), F.col("label").cast("string").alias("class_label"),
                       "class_vec")


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    return N.nearest_class(emb, "embedding", _classes(emb))


@register("nearest_class", "VEC5 VEC6 JN2 VEC4", sql=f"""
WITH {_SIMS_SQL}
SELECT vec_id, label, CAST(class_idx AS INTEGER) AS predicted_idx, CAST(class_idx AS VARCHAR) AS predicted_label,
       round(sim, 6) AS sim, class_idx = label AS correct
FROM best""")
def nearest_class(spark: SparkSession, sf: str) -> DataFrame:
    out = _nearest(spark, sf)
    return out.select("vec_id", "label", "predicted_idx", "predicted_label", F.round("sim", 6).alias("sim"),
                      (F.col("predicted_idx") == F.col("label")).alias("correct"))


@register("nearest_class_metrics", "VEC5 AGG1 AGG6-8 (flagship)", sql=f"""
WITH {_SIMS_SQL},
f AS (SELECT CAST(label AS VARCHAR) AS gt, CAST(class_idx AS VARCHAR) AS pred FROM best),
tl AS (SELECT gt AS label, CAST(row_number() OVER (ORDER BY gt) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT gt FROM f)),
sup AS (SELECT gt AS class, count(*) AS support FROM f GROUP BY ALL),
prd AS (SELECT pred AS class, count(*) AS predicted FROM f GROUP BY ALL),
tp AS (SELECT gt AS class, count(*) AS tp FROM f WHERE pred = gt GROUP BY ALL),
st AS (SELECT t.idx AS class_idx, t.label AS class, coalesce(s.support, 0) AS support,
              coalesce(p.predicted, 0) AS predicted, coalesce(x.tp, 0) AS tp
       FROM tl t LEFT JOIN sup s ON s.class = t.label LEFT JOIN prd p ON p.class = t.label
       LEFT JOIN tp x ON x.class = t.label)
SELECT class_idx, class, support, predicted, tp,
       round(CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END, 6) AS precision,
       round(CASE WHEN support = 0 THEN 0.0 ELSE tp / support END, 6) AS recall,
       round(CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END, 6) AS f1
FROM st""")
def nearest_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = _nearest(spark, sf).select(F.col("label").cast("string").alias("gt"),
                                     F.col("predicted_label").alias("pred"))
    prf = M.precision_recall_f1(M.class_stats(M.pair_counts(out, []), []))
    return prf.select("class_idx", "class", "support", "predicted", "tp",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("cosine_matrix", "VEC3 VEC4 JN2", sql=f"""
WITH {_SIMS_SQL}
SELECT vec_id, CAST(class_idx AS INTEGER) AS class_idx, CAST(class_idx AS VARCHAR) AS class_label,
       round(sim, 6) AS sim
FROM sims""")
def cosine_matrix(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    out = N.cosine_matrix(emb, "embedding", _classes(emb), keep=["vec_id"])
    return out.select("vec_id", "class_idx", "class_label", F.round("sim", 6).alias("sim"))


@register("vector_norms", "VEC2", sql="""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm
FROM embeddings""")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    return emb.select("vec_id", F.size("embedding").alias("dim"), F.round(l2_norm("embedding"), 6).alias("norm"))


@register("class_softmax", "VEC7", sql=f"""
WITH {_SIMS_SQL},
m AS (SELECT vec_id, max(sim) AS top FROM sims GROUP BY vec_id),
e AS (SELECT s.vec_id, s.class_idx, exp({LOGIT_SCALE} * s.sim - {LOGIT_SCALE} * m.top) AS w
      FROM sims s JOIN m USING (vec_id))
SELECT vec_id, CAST(class_idx AS INTEGER) AS class_idx, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS prob
FROM e""")
def class_softmax(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    out = N.class_softmax(emb, "embedding", _classes(emb), LOGIT_SCALE, keep=["vec_id"])
    return out.select("vec_id", "class_idx", F.round("prob", 6).alias("prob"))


@register("zero_shot", "VEC8 VEC4 VEC7 VEC5", sql=f"""
WITH {_SIMS_SQL},
m AS (SELECT vec_id, max(sim) AS top, sum(exp({LOGIT_SCALE} * sim)) AS z0 FROM sims GROUP BY vec_id),
z AS (SELECT s.vec_id, sum(exp({LOGIT_SCALE} * s.sim - {LOGIT_SCALE} * m.top)) AS z FROM sims s JOIN m USING (vec_id)
      GROUP BY s.vec_id)
SELECT b.vec_id, b.label, CAST(b.class_idx AS INTEGER) AS predicted_idx,
       round(exp({LOGIT_SCALE} * b.sim - {LOGIT_SCALE} * m.top) / z.z, 6) AS prob, b.class_idx = b.label AS correct
FROM best b JOIN m USING (vec_id) JOIN z USING (vec_id)""")
def zero_shot(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf)
    out = N.zero_shot(emb, "embedding", "label", _classes(emb), LOGIT_SCALE)
    return out.select("vec_id", "label", "predicted_idx", F.round("prob", 6).alias("prob"), "correct")


@register("classify_features", "VEC8 JN1 VEC5 VEC7", sql=f"""
WITH {_SIMS_SQL},
m AS (SELECT vec_id, max(sim) AS top FROM sims GROUP BY vec_id),
z AS (SELECT s.vec_id, sum(exp({LOGIT_SCALE} * s.sim - {LOGIT_SCALE} * m.top)) AS z FROM sims s JOIN m USING (vec_id)
      GROUP BY s.vec_id)
SELECT 'images/emb_' || CAST(vec_id AS VARCHAR) || '.jpg' AS file, 'class ' || CAST(b.label AS VARCHAR) AS gt,
       'class ' || CAST(b.class_idx AS VARCHAR) AS predicted_label, round(b.sim, 6) AS sim, round(1 / z.z, 6) AS prob,
       b.class_idx = b.label AS correct
FROM best b JOIN z USING (vec_id)""")
def classify_features_query(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations joined to the feature table on the file key, then the direct zero-shot route."""
    file = F.concat(F.lit("images/emb_"), F.col("vec_id").cast("string"), F.lit(".jpg"))
    emb = _emb(spark, sf)
    annotations = emb.select(file.alias("file"), F.concat(F.lit("Class_"), F.col("label").cast("string")).alias("style"))
    features = emb.select(file.alias("file"), F.col("embedding").alias("features"))
    classes = _classes(emb).withColumn("class_label", F.concat(F.lit("class "), "class_label"))
    out = classify_features(annotations, features, classes, "style", LOGIT_SCALE)
    return out.select("file", "gt", "predicted_label", F.round("sim", 6).alias("sim"), F.round("prob", 6).alias("prob"), "correct")


@register("feature_table", "SNK4", sql="""
SELECT 'images/emb_' || CAST(vec_id AS VARCHAR) || '.jpg' AS file, 'emb_' || CAST(vec_id AS VARCHAR) || '.pt' AS feature_file,
       CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm
FROM embeddings""")
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    emb = _emb(spark, sf).withColumn("file", F.concat(F.lit("images/emb_"), F.col("vec_id").cast("string"),
                                                       F.lit(".jpg")))
    return emb.select("file", feature_file_name("file").alias("feature_file"),
                      F.size("embedding").alias("dim"), F.round(l2_norm("embedding"), 6).alias("norm"))

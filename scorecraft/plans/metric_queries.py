"""Metric queries bound to the driver tables.

Predictions are derived from ``lineitem``: ground truth is the return flag
(``Z`` for the largest quantities, a class that is never predicted), and the
"model" answer is a fixed rule over the part key that includes a
lower-case variant, an out-of-label value and plain hits.  Runs are
``dataset = l_linestatus`` x ``model = m<l_linenumber % 4>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions.text import report_key_lower, report_key_underscore
from scorecraft.operators import metrics as M
from scorecraft.plans.registry import register, table

SERIES = ["m0", "m1", "m2", "m3"]
FLAG_DISPLAY = ["A (accepted)", "N (none)", "R (returned)", "Z (bulk)"]

FACTS_SQL = """
facts AS (
  SELECT l_orderkey, l_linenumber, l_linestatus AS dataset,
         'm' || CAST(l_linenumber % 4 AS VARCHAR) AS model,
         CASE WHEN l_quantity > 49 THEN 'Z' ELSE l_returnflag END AS gt,
         CASE l_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'N' WHEN 2 THEN 'X'
              WHEN 3 THEN l_returnflag
              ELSE CASE WHEN l_returnflag = 'R' THEN 'N' ELSE l_returnflag END END AS pred
  FROM lineitem)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    pk = F.col("l_partkey") % 5
    pred = (F.when(pk == 0, F.lit("a")).when(pk == 1, F.lit("N")).when(pk == 2, F.lit("X"))
             .when(pk == 3, F.col("l_returnflag"))
             .otherwise(F.when(F.col("l_returnflag") == "R", F.lit("N")).otherwise(F.col("l_returnflag"))))
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("dataset"),
        F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("model"),
        F.when(F.col("l_quantity") > 49, F.lit("Z")).otherwise(F.col("l_returnflag")).alias("gt"),
        pred.alias("pred"))


def _counts(spark, sf, runs, norm=report_key_lower):
    f = facts(spark, sf)
    return M.pair_counts(f.select(*runs, norm("gt").alias("gt"), norm("pred").alias("pred")), runs)


# --- AGG1 / PRJ3 -------------------------------------------------------------

@register("accuracy_by_run", "AGG1 PRJ3", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT model, replace(lower(gt), ' ', '_') AS gt, replace(lower(pred), ' ', '_') AS pred FROM facts)
SELECT model, count(*) AS n,
       CAST(sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(100.0 * sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) / count(*), 6)
         AS accuracy
FROM f GROUP BY model""")
def accuracy_by_run(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, ["model"], report_key_underscore)
    return (M.accuracy(counts, ["model"])
            .select("model", F.col("n").cast("bigint").alias("n"), F.col("correct").cast("bigint").alias("correct"),
                    F.round("accuracy", 6).alias("accuracy")))


# --- AGG3 / SRT1 -------------------------------------------------------------

_LABELS_SQL = """
cnt AS (SELECT model, gt, pred, count(*) AS n FROM f GROUP BY ALL),
tl AS (SELECT model, gt AS label, CAST(row_number() OVER (PARTITION BY model ORDER BY gt) - 1 AS INTEGER) AS idx
       FROM (SELECT DISTINCT model, gt FROM f WHERE gt IS NOT NULL)),
pl AS (SELECT model, pred AS label, CAST(row_number() OVER (PARTITION BY model ORDER BY pred) - 1 AS INTEGER) AS idx
       FROM (SELECT DISTINCT model, pred FROM f WHERE pred IS NOT NULL))"""


@register("confusion_matrix", "AGG3 SRT1 PRJ4", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT model, lower(gt) AS gt, lower(pred) AS pred FROM facts), {_LABELS_SQL}
SELECT t.model, t.idx AS true_idx, t.label AS true_label, p.idx AS pred_idx, p.label AS pred_label,
       coalesce(c.n, 0) AS n
FROM tl t JOIN tl p ON t.model = p.model
LEFT JOIN cnt c ON c.model = t.model AND c.gt = t.label AND c.pred = p.label""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, ["model"])
    return M.confusion_long(counts, ["model"]).select(
        "model", "true_idx", "true_label", "pred_idx", "pred_label", "n")


# --- AGG4 / JN3 --------------------------------------------------------------

@register("confusion_subset", "AGG4 JN3", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT model, lower(gt) AS gt, lower(pred) AS pred FROM facts), {_LABELS_SQL}
SELECT t.model, t.idx AS true_idx, t.label AS true_label, p.idx AS pred_idx, p.label AS pred_label,
       coalesce(c.n, 0) AS n
FROM tl t JOIN pl p ON t.model = p.model
LEFT JOIN cnt c ON c.model = t.model AND c.gt = t.label AND c.pred = p.label""")
def confusion_subset(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, ["model"])
    return M.confusion_long(counts, ["model"], M.independent_domains(counts, ["model"])).select(
        "model", "true_idx", "true_label", "pred_idx", "pred_label", "n")


# --- AGG5 --------------------------------------------------------------------

@register("confusion_wide", "AGG5", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT model, lower(gt) AS gt, lower(pred) AS pred FROM facts), {_LABELS_SQL}
SELECT t.model, t.idx AS true_idx, t.label AS true_label,
       CAST(coalesce(sum(CASE WHEN c.pred = 'a' THEN c.n END), 0) AS BIGINT) AS a,
       CAST(coalesce(sum(CASE WHEN c.pred = 'n' THEN c.n END), 0) AS BIGINT) AS n,
       CAST(coalesce(sum(CASE WHEN c.pred = 'r' THEN c.n END), 0) AS BIGINT) AS r,
       CAST(coalesce(sum(CASE WHEN c.pred = 'z' THEN c.n END), 0) AS BIGINT) AS z
FROM tl t LEFT JOIN cnt c ON c.model = t.model AND c.gt = t.label
GROUP BY t.model, t.idx, t.label""")
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, ["model"])
    labels = ["a", "n", "r", "z"]
    wide = M.confusion_wide(M.confusion_long(counts, ["model"]), ["model"], labels)
    return wide.select("model", "true_idx", "true_label", *[F.col(c).cast("bigint").alias(c) for c in labels])


# --- AGG6-8 / PRJ4 / SRT1 ------------------------------------------------------

_PRF_SQL = """
sup AS (SELECT model, gt AS class, count(*) AS support FROM f GROUP BY ALL),
prd AS (SELECT model, pred AS class, count(*) AS predicted FROM f GROUP BY ALL),
tp AS (SELECT model, gt AS class, count(*) AS tp FROM f WHERE pred = gt GROUP BY ALL),
st AS (SELECT t.model, t.idx AS class_idx, t.label AS class,
              coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted, coalesce(x.tp, 0) AS tp
       FROM tl t LEFT JOIN sup s ON s.model = t.model AND s.class = t.label
       LEFT JOIN prd p ON p.model = t.model AND p.class = t.label
       LEFT JOIN tp x ON x.model = t.model AND x.class = t.label),
prf AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1
        FROM st)"""


def _prf(spark, sf, runs):
    counts = _counts(spark, sf, runs)
    return M.precision_recall_f1(M.class_stats(counts, runs))


@register("prf_per_class", "AGG6 AGG7 AGG8 PRJ4 SRT1", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT model, lower(gt) AS gt, lower(pred) AS pred FROM facts), {_LABELS_SQL}, {_PRF_SQL}
SELECT model, class_idx, class, support, predicted, tp,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM prf""")
def prf_per_class(spark: SparkSession, sf: str) -> DataFrame:
    prf = _prf(spark, sf, ["model"])
    return prf.select("model", "class_idx", "class", "support", "predicted", "tp",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- AGG11 -------------------------------------------------------------------

@register("metrics_long", "AGG11", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT model, lower(gt) AS gt, lower(pred) AS pred FROM facts), {_LABELS_SQL}, {_PRF_SQL},
k AS (SELECT model, max(class_idx) + 1 AS k FROM prf GROUP BY model),
u AS (UNPIVOT prf ON precision, recall, f1 INTO NAME metric VALUE value)
SELECT u.model, u.class_idx, u.class, u.metric, round(u.value, 6) AS value,
       round(2.0 + u.class_idx * CASE WHEN k.k > 1 THEN 96.0 / (k.k - 1) ELSE 0.0 END
             + 0.4 * (CAST(substr(u.model, 2) AS INTEGER)), 6) AS x
FROM u JOIN k ON k.model = u.model""")
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    prf = _prf(spark, sf, ["model"])
    long = M.metrics_long(prf.select("model", "class_idx", "class", "precision", "recall", "f1"),
                          ["model"], "model", SERIES)
    return long.select("model", "class_idx", "class", "metric",
                       F.round("value", 6).alias("value"), F.round("x", 6).alias("x"))


# --- AU5 ---------------------------------------------------------------------

@register("class_support", "AU5", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT lower(gt) AS gt, lower(pred) AS pred FROM facts),
tl AS (SELECT gt AS label, CAST(row_number() OVER (ORDER BY gt) - 1 AS INTEGER) AS idx
       FROM (SELECT DISTINCT gt FROM f WHERE gt IS NOT NULL)),
sup AS (SELECT gt AS class, count(*) AS support FROM f GROUP BY ALL),
prd AS (SELECT pred AS class, count(*) AS predicted FROM f GROUP BY ALL)
SELECT t.idx AS class_idx, t.label AS class, coalesce(s.support, 0) AS support,
       coalesce(p.predicted, 0) AS predicted, coalesce(p.predicted, 0) = 0 AS never_predicted
FROM tl t LEFT JOIN sup s ON s.class = t.label LEFT JOIN prd p ON p.class = t.label""")
def class_support(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, [])
    st = M.class_stats(counts, [])
    return st.select("class_idx", "class", "support", "predicted",
                     (F.col("predicted") == 0).alias("never_predicted"))


# --- SRT2 --------------------------------------------------------------------

@register("display_labels", "SRT2 SRT1", sql=f"""
WITH {FACTS_SQL},
tl AS (SELECT dataset, label, CAST(row_number() OVER (PARTITION BY dataset ORDER BY label) - 1 AS INTEGER) AS idx
       FROM (SELECT DISTINCT dataset, lower(gt) AS label FROM facts WHERE gt IS NOT NULL)),
d AS (SELECT * FROM (VALUES (0, '{FLAG_DISPLAY[0]}'), (1, '{FLAG_DISPLAY[1]}'), (2, '{FLAG_DISPLAY[2]}'),
                             (3, '{FLAG_DISPLAY[3]}')) AS v(idx, display))
SELECT tl.dataset, tl.idx AS class_idx, tl.label AS class, d.display
FROM tl JOIN d ON d.idx = tl.idx""")
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, ["dataset"])
    dom = M.label_domain(counts, ["dataset"], "gt")
    return M.display_labels(dom, ["dataset"], FLAG_DISPLAY).select("dataset", "class_idx", "class", "display")


# --- AGG10 -------------------------------------------------------------------

@register("series_stats", "AGG10", sql="""
SELECT l_returnflag AS series, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean,
       round(stddev_pop(l_extendedprice), 4) AS std
FROM lineitem GROUP BY l_returnflag""")
def series_stats(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), "l_extendedprice")
    return M.series_stats(li, ["series"], "l_extendedprice").select(
        "series", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


# --- AGG9 --------------------------------------------------------------------

@register("model_comparison", "AGG9 AGG1 AGG6-8", sql=f"""
WITH {FACTS_SQL},
f AS (SELECT dataset || '/' || model AS model, lower(gt) AS gt, lower(pred) AS pred FROM facts),
{_LABELS_SQL}, {_PRF_SQL},
acc AS (SELECT model, count(*) AS n,
               100.0 * sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) / count(*) AS a
        FROM f GROUP BY model),
mac AS (SELECT model, count(*) AS n_classes, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM prf GROUP BY model)
SELECT split_part(acc.model, '/', 1) AS dataset, split_part(acc.model, '/', 2) AS model, acc.n,
       round(acc.a, 6) AS accuracy, mac.n_classes, round(mac.p, 6) AS macro_precision,
       round(mac.r, 6) AS macro_recall, round(mac.f, 6) AS macro_f1
FROM acc JOIN mac ON mac.model = acc.model""")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    runs = ["dataset", "model"]
    counts = _counts(spark, sf, runs)
    acc = M.accuracy(counts, runs)
    mac = M.macro_average(M.precision_recall_f1(M.class_stats(counts, runs)), runs)
    return acc.join(mac, runs).select(
        "dataset", "model", F.col("n").cast("bigint").alias("n"), F.round("accuracy", 6).alias("accuracy"),
        "n_classes", *[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


# --- SRC5 --------------------------------------------------------------------

@register("result_preference", "SRC5", sql=f"""
WITH {FACTS_SQL},
u AS (SELECT model, gt, pred, 2 AS prio FROM facts
      UNION ALL
      SELECT model, lower(gt) AS gt, lower(pred) AS pred, 1 AS prio FROM facts WHERE model IN ('m0', 'm2')),
b AS (SELECT *, min(prio) OVER (PARTITION BY model) AS best FROM u)
SELECT model, CASE WHEN min(prio) = 1 THEN 'processed' ELSE 'raw' END AS source, count(*) AS n,
       CAST(sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(100.0 * sum(CASE WHEN gt IS NOT NULL AND pred IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END) / count(*), 6)
         AS accuracy
FROM b WHERE prio = best GROUP BY model""")
def result_preference(spark: SparkSession, sf: str) -> DataFrame:
    from scorecraft.sources.files import prefer_processed
    f = facts(spark, sf)
    raw = f.select("model", "gt", "pred")
    processed = (f.where(F.col("model").isin("m0", "m2"))
                  .select("model", F.lower("gt").alias("gt"), F.lower("pred").alias("pred")))
    chosen = prefer_processed(raw, processed, ["model"])
    counts = M.pair_counts(chosen, ["model", "source"])
    return (M.accuracy(counts, ["model", "source"])
            .select("model", "source", F.col("n").cast("bigint").alias("n"),
                    F.col("correct").cast("bigint").alias("correct"), F.round("accuracy", 6).alias("accuracy")))

"""The end-to-end zero-shot evaluation job, bound to the driver tables.

Two runs are built from the tables and evaluated together in one job:

* ``PartBrands_author_LLaVa`` -- who made each part: chat answers naming a
  brand (some wrong, some with no usable term), scored by nearest class over
  the run's domain (distinct ground truth plus ``unknown``);
* ``Orders_year_LLaVa`` -- when each order was placed: century / year /
  decade phrases, scored by the year route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.plans import sqlgen as S
from scorecraft.plans.evaluate import evaluate_predictions
from scorecraft.plans.registry import register, table
from scorecraft.plans.text_queries import _YEAR_R_SQL, _year_answers

NL = "\n"
# The two runs' rule profiles (what their manifests would give).
PROFILES = ["LLaVA|author|false|false", "LLaVA|year|false|false"]
_CHAT_HEAD = f"USER:  {NL}Who is the author of this painting?{NL}ASSISTANT: "
_AUTHOR_ANSWER_SQL = (
    "CASE p_partkey % 4 WHEN 0 THEN 'The author is ' || replace(p_brand, '#', ' ') || '.' "
    "WHEN 1 THEN 'Brand ' || CAST(p_size AS VARCHAR) "
    "WHEN 2 THEN 'I cannot tell.' "
    "ELSE p_name || ' by ' || replace(p_brand, '#', ' ') END")


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    brand = F.replace("p_brand", F.lit("#"), F.lit(" "))
    answer = (F.when(k == 0, F.concat(F.lit("The author is "), brand, F.lit(".")))
               .when(k == 1, F.concat(F.lit("Brand "), F.col("p_size").cast("string")))
               .when(k == 2, F.lit("I cannot tell."))
               .otherwise(F.concat(F.col("p_name"), F.lit(" by "), brand)))
    author = p.select(F.lit("PartBrands_author_LLaVa").alias("run"), F.lit("PartBrands").alias("dataset"),
                      F.lit("author").alias("attribute"), F.lit("LLaVa").alias("model"),
                      F.col("p_partkey").alias("row_idx"), F.lower(brand).alias("gt"),
                      F.concat(F.lit(_CHAT_HEAD), answer).alias("preds"))
    o = _year_answers(table(spark, sf, "orders"))
    year = o.select(F.lit("Orders_year_LLaVa").alias("run"), F.lit("Orders").alias("dataset"),
                    F.lit("year").alias("attribute"), F.lit("LLaVa").alias("model"),
                    F.col("o_orderkey").alias("row_idx"), F.col("year").cast("string").alias("gt"),
                    F.concat(F.lit(f"USER:  {NL}When was this painting made?{NL}ASSISTANT: "), F.col("preds"))
                    .alias("preds"))
    return author.unionByName(year)


def _sql() -> str:
    terms = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+', 0)"
    base = f"""
p AS (SELECT 'PartBrands_author_LLaVa' AS run, 'author' AS attribute, p_partkey AS row_idx,
             lower(replace(p_brand, '#', ' ')) AS gt,
             'USER:  ' || chr(10) || 'Who is the author of this painting?' || chr(10) || 'ASSISTANT: ' ||
             ({_AUTHOR_ANSWER_SQL}) AS preds FROM part
      UNION ALL
      SELECT 'Orders_year_LLaVa', 'year', o_orderkey, CAST(year(o_orderdate) AS VARCHAR),
             'USER:  ' || chr(10) || 'When was this painting made?' || chr(10) || 'ASSISTANT: ' ||
             ({_YEAR_R_SQL}) FROM orders),
b AS (SELECT run, attribute, row_idx, gt, 'LLaVA|' || attribute || '|false|false' AS profile,
             {S.fewshot(S.pre_clean('preds'))} AS x FROM p)"""
    ctes, last = S.dispatch("b", "x", [("LLaVA", "author", False, False), ("LLaVA", "year", False, False)])
    rest = f"""
d AS (SELECT run, attribute, row_idx, gt, x AS pred_clean FROM {last}),
dom AS (SELECT run, class, CAST(row_number() OVER (PARTITION BY run ORDER BY class) - 1 AS INTEGER) AS class_idx
        FROM (SELECT DISTINCT run, lower(replace(gt, '_', ' ')) AS class FROM d WHERE attribute = 'author'
              UNION SELECT DISTINCT run, 'unknown' FROM d WHERE attribute = 'author')),
lt AS (SELECT run, row_idx, unnest({terms.format('pred_clean')}) AS term FROM d WHERE attribute = 'author'),
ltf AS (SELECT run, row_idx, term, count(*) AS tf FROM lt GROUP BY ALL),
ln AS (SELECT run, row_idx, sqrt(sum(tf * tf)) AS norm FROM ltf GROUP BY ALL),
ct AS (SELECT run, class_idx, unnest({terms.format('class')}) AS term FROM dom),
ctf AS (SELECT run, class_idx, term, count(*) AS tf FROM ct GROUP BY ALL),
cn AS (SELECT run, class_idx, sqrt(sum(tf * tf)) AS norm FROM ctf GROUP BY ALL),
pairs AS (SELECT l.run, l.row_idx, c.class_idx, sum(l.tf * c.tf) AS dot
          FROM ltf l JOIN ctf c ON c.run = l.run AND c.term = l.term GROUP BY ALL),
cos AS (SELECT p.run, p.row_idx, p.class_idx, p.dot / (ln.norm * cn.norm) AS cosine
        FROM pairs p JOIN ln USING (run, row_idx) JOIN cn USING (run, class_idx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, row_idx
                                                     ORDER BY round(cosine, 9) DESC, class_idx) AS rn FROM cos)
         WHERE rn = 1),
scored AS (SELECT d.run, d.row_idx, d.attribute, d.gt,
                  CASE WHEN d.attribute = 'year' THEN {S.bucket(S.first_year('d.pred_clean'), 100)}
                       ELSE dom.class END AS predicted_class,
                  CASE WHEN d.attribute = 'year' THEN {S.bucket('d.gt', 100)} ELSE d.gt END AS gt_key
           FROM d LEFT JOIN best b ON b.run = d.run AND b.row_idx = d.row_idx
           LEFT JOIN dom ON dom.run = d.run AND dom.class_idx = coalesce(b.class_idx, 0))
SELECT run, row_idx, predicted_class, gt_key, coalesce(predicted_class = gt_key, false) AS correct FROM scored"""
    return "WITH " + base + ", " + ", ".join(ctes) + ", " + rest


@register("zeroshot_eval", "end-to-end: TXT17 DOM1-3 PRM3 VEC1 JN2 VEC5 VEC6 SNK2 AGG1", sql=_sql())
def zeroshot_eval(spark: SparkSession, sf: str) -> DataFrame:
    ev = evaluate_predictions(_predictions(spark, sf), profiles=PROFILES)
    return ev.select("run", "row_idx", "predicted_class", "gt_key", "correct")


@register("zeroshot_eval_accuracy", "end-to-end + AGG1 per run", sql=f"""
WITH s AS ({_sql()})
SELECT run, count(*) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(100.0 * sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM s GROUP BY run""")
def zeroshot_eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    from scorecraft.operators import metrics as M
    ev = evaluate_predictions(_predictions(spark, sf), profiles=PROFILES)
    acc = M.accuracy(M.pair_counts(ev.select("run", F.col("gt_key").alias("gt"),
                                             F.col("predicted_class").alias("pred")), ["run"]), ["run"])
    return acc.select("run", F.col("n").cast("bigint").alias("n"), F.col("correct").cast("bigint").alias("correct"),
                      F.round("accuracy", 6).alias("accuracy"))


@register("zeroshot_eval_confusion", "AGG3 DOM1 DOM3: confusion over the run's class list", sql=f"""
WITH s AS ({_sql()}),
lists AS (
  SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY class) - 1 AS INTEGER) AS idx, class
  FROM (SELECT DISTINCT run, gt_key AS class FROM s WHERE run = 'PartBrands_author_LLaVa' UNION SELECT 'PartBrands_author_LLaVa', 'unknown')
  UNION ALL SELECT 'Orders_year_LLaVa', CAST((c - 1400) / 100 AS INTEGER), CAST(c AS VARCHAR) FROM range(1400, 2100, 100) AS t(c)),
found AS (
  SELECT s.run, t.idx AS true_idx, t.class AS true_label, p.idx AS pred_idx, p.class AS pred_label, count(*) AS n
  FROM s LEFT JOIN lists t ON t.run = s.run AND t.class = s.gt_key LEFT JOIN lists p ON p.run = s.run AND p.class = s.predicted_class GROUP BY ALL),
grid AS (
  SELECT t.run, t.idx AS true_idx, t.class AS true_label, p.idx AS pred_idx, p.class AS pred_label FROM lists t JOIN lists p ON p.run = t.run)
SELECT g.*, CAST(coalesce(f.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN found f
  ON f.run = g.run AND f.true_label = g.true_label AND f.pred_label = g.pred_label
UNION ALL SELECT run, true_idx, true_label, pred_idx, pred_label, n FROM found WHERE true_idx IS NULL OR pred_idx IS NULL""")
def zeroshot_eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job's confusion: ``unknown`` is never true, centuries before the orders are neither true nor answered."""
    from scorecraft.plans.evaluate import run_report
    ev = evaluate_predictions(_predictions(spark, sf), profiles=PROFILES)
    return run_report(ev)["confusion"].select("run", "true_idx", "true_label", "pred_idx", "pred_label", "n")

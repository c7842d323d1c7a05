"""Accuracy, confusion matrices and per-class precision / recall / F1.

Plan shape: the (possibly huge) prediction table is aggregated **once** to a
``(run..., gt, pred, n)`` count table with partial (map-side) aggregation.
Every metric is then derived from that small table, so five reports cost one
shuffle of the facts instead of five.  Dense outputs (zero cells) are built by
exploding the bounded label domain of each run, never by joining facts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(p: Column, g: Column) -> Column:
    """Null-safe equality that never counts a NULL ground truth as a hit."""
    return g.isNotNull() & p.eqNullSafe(g)


def pair_counts(df: DataFrame, runs: Sequence[str], gt: str = "gt", pred: str = "pred",
                persist: bool = True) -> DataFrame:
    """``(runs..., gt, pred, n)`` -- the only pass over the facts.

    The count table is persisted (memory, spilling to disk) because every
    report reads it several times; without that each branch would re-scan the
    facts.  Its size is bounded by the distinct (run, gt, pred) triples.
    """
    out = (df.select(*runs, F.col(gt).alias("gt"), F.col(pred).alias("pred"))
             .groupBy(*runs, "gt", "pred").agg(F.count(F.lit(1)).alias("n")))
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def accuracy(counts: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Matches / rows x 100 per run; unequal or NULL counts as a miss."""
    hit = F.when(_same(F.col("pred"), F.col("gt")), F.col("n")).otherwise(F.lit(0))
    return (counts.groupBy(*runs)
                  .agg(F.sum("n").alias("n"), F.sum(hit).alias("correct"))
                  .withColumn("accuracy", F.col("correct") / F.col("n") * 100.0))


def accuracy_over(counts: DataFrame, runs: Sequence[str], denominators: DataFrame) -> DataFrame:
    """Accuracy against an external denominator (all annotated items, even if fewer scored).

    ``denominators`` has the run columns and ``n_total``; without run columns it is one row.
    """
    acc = accuracy(counts, runs)
    joined = acc.join(denominators, list(runs), "left") if runs else acc.withColumn("n_total", denominators.select("n_total").scalar())
    return (joined
               .withColumn("accuracy_all", F.col("correct") / F.col("n_total") * 100.0))


def label_domain(counts: DataFrame, runs: Sequence[str], side: str = "gt",
                 name: str = "labels") -> DataFrame:
    """Sorted distinct labels of one side per run (``sorted(set(gt))``)."""
    return (counts.where(F.col(side).isNotNull()).groupBy(*runs)
                  .agg(F.array_sort(F.collect_set(side)).alias(name)))


def confusion_long(counts: DataFrame, runs: Sequence[str], domains: DataFrame | None = None) -> DataFrame:
    """Dense confusion matrix in long form ``(runs..., true_idx, true_label, pred_idx, pred_label, n)``.

    ``domains`` holds, per run, the array columns ``true_labels`` and
    ``pred_labels``; by default both are the sorted distinct gt (sklearn's
    ``labels=``).  Pairs with either side outside its domain are dropped,
    absent pairs are zero.  The grid comes from exploding the two label arrays
    of each run row, so no join between fact rows is needed.  It is lazy and has
    labels x labels rows per run; nothing is computed before it is read, so a
    run with very many labels does not keep the other parts of a report from use.
    """
    runs = list(runs)
    if domains is None:
        domains = (label_domain(counts, runs, "gt")
                   .select(*runs, F.col("labels").alias("true_labels"), F.col("labels").alias("pred_labels")))
    grid = (domains.select(*runs, "pred_labels", F.posexplode("true_labels").alias("true_idx", "true_label"))
                   .select(*runs, "true_idx", "true_label",
                           F.posexplode("pred_labels").alias("pred_idx", "pred_label")))
    facts = counts.select(*runs, F.col("gt").alias("true_label"), F.col("pred").alias("pred_label"), "n")
    return (grid.join(facts, runs + ["true_label", "pred_label"], "left")
                .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def confusion_over(counts: DataFrame, runs: Sequence[str], classes: DataFrame) -> DataFrame:
    """Confusion matrix over each run's class list, in its order: ``(runs..., true_idx, true_label, pred_idx, pred_label, n)``.

    ``classes`` holds (runs..., class_idx, class).  Every pair of the list has a row, classes that are never
    true or never answered too.  Whatever lies outside the list, NULL included, is gathered under a NULL label, in rows of their own
    where there is any, so that the counts of a run add up to its rows.  The counted cells are joined with the
    list; the zero cells come from exploding the list of each run.
    """
    runs = list(runs)
    listed = classes.select(*runs, "class_idx", "class").dropDuplicates([*runs, "class"])

    def side(df: DataFrame, label: str, idx: str, name: str) -> DataFrame:
        known = listed.select(*runs, F.col("class_idx").alias(idx), F.col("class").alias(name))
        return df.join(known.withColumn(label, F.col(name)), [*runs, label], "left")

    cells = side(side(counts, "gt", "true_idx", "true_label"), "pred", "pred_idx", "pred_label")
    found = cells.groupBy(*runs, "true_idx", "true_label", "pred_idx", "pred_label").agg(F.sum("n").cast("bigint").alias("n"))
    lists = listed.groupBy(*runs).agg(F.sort_array(F.collect_list(F.struct("class_idx", "class"))).alias("_l"))
    grid = lists.select(*runs, "_l", F.explode("_l").alias("_t")).select(*runs, "_t", F.explode("_l").alias("_p")).select(
        *runs, F.col("_t.class_idx").alias("true_idx"), F.col("_t.class").alias("true_label"),
        F.col("_p.class_idx").alias("pred_idx"), F.col("_p.class").alias("pred_label"), F.lit(0).cast("bigint").alias("n"))
    # zero cells and counted ones are summed, which needs no join on labels that may be NULL
    return (grid.unionByName(found).groupBy(*runs, "true_idx", "true_label", "pred_idx", "pred_label")
            .agg(F.sum("n").cast("bigint").alias("n")))


def independent_domains(counts: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Row labels = sorted distinct gt, column labels = sorted distinct pred, per run."""
    runs = list(runs)
    t = label_domain(counts, runs, "gt", "true_labels")
    p = label_domain(counts, runs, "pred", "pred_labels")
    return t.join(p, runs, "full") if runs else t.select("true_labels", p.scalar().alias("pred_labels"))


def confusion_rows(counts: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Confusion matrix as one row per (run, true label) with an aligned count array.

    ``(runs..., true_idx, true_label, pred_labels, counts)``: ``counts[j]`` is
    the number of answers with this true label predicted as ``pred_labels[j]``
    (the sorted gt domain).  No pivot pass to discover the labels and no
    per-cell rows: each true label's observed cells are gathered into a map
    (bounded by the domain) and read out in domain order.
    """
    runs = list(runs)
    dom = label_domain(counts, runs, "gt")
    cells = (counts.where(F.col("gt").isNotNull() & F.col("pred").isNotNull())
                   .groupBy(*runs, "gt").agg(F.map_from_entries(F.collect_list(F.struct("pred", "n"))).alias("_m")))
    rows = dom.select(*runs, "labels", F.posexplode("labels").alias("true_idx", "true_label"))
    out = rows.join(cells.withColumnRenamed("gt", "true_label"), runs + ["true_label"], "left")
    return out.select(*runs, "true_idx", "true_label", F.col("labels").alias("pred_labels"),
                      F.transform("labels", lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0)).cast("bigint"))
                      .alias("counts"))


def confusion_wide(long: DataFrame, runs: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per true label, one column per predicted label (given order)."""
    return (long.groupBy(*runs, "true_idx", "true_label")
                .pivot("pred_label", list(labels)).agg(F.sum("n"))
                .na.fill(0, subset=list(labels)))


def class_stats(counts: DataFrame, runs: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """Per (run, class): support, predicted, tp over the class domain.

    The domain defaults to the sorted distinct gt.  Predictions outside it
    are misses for their gt class and never counted as a class prediction.
    Default domain: one pass over the count table -- each cell contributes
    to its gt class (support, tp) and to its predicted class (predicted);
    the classes with support are exactly the gt domain.
    """
    runs = list(runs)
    if labels is None:
        hit = _same(F.col("pred"), F.col("gt"))
        sides = F.array(
            F.struct(F.col("gt").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(hit, F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))
        per = (counts.select(*runs, F.explode(sides).alias("s")).where(F.col("s.class").isNotNull())
                     .groupBy(*runs, F.col("s.class").alias("class"))
                     .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
                          F.sum("s.tp").alias("tp"))
                     .where(F.col("support") > 0))
        w = Window.partitionBy(*runs).orderBy("class") if runs else Window.orderBy("class")
        return per.select(*runs, (F.row_number().over(w) - 1).cast("int").alias("class_idx"), "class",
                          *[F.col(c).cast("bigint").alias(c) for c in ("support", "predicted", "tp")])
    classes = labels.select(*runs, F.posexplode("labels").alias("class_idx", "class"))
    support = counts.groupBy(*runs, F.col("gt").alias("class")).agg(F.sum("n").alias("support"))
    predicted = counts.groupBy(*runs, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    tp = (counts.where(_same(F.col("pred"), F.col("gt")))
                .groupBy(*runs, F.col("gt").alias("class")).agg(F.sum("n").alias("tp")))
    keys = runs + ["class"]
    out = classes.join(support, keys, "left").join(predicted, keys, "left").join(tp, keys, "left")
    return out.select(*runs, "class_idx", "class",
                      *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("support", "predicted", "tp")])


def precision_recall_f1(stats: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1; an undefined ratio is 0 (sklearn's zero_division)."""
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double")), F.lit(0.0))
    return (stats.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
                 .withColumn("recall", ratio(F.col("tp"), F.col("support")))
                 .withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def macro_average(prf: DataFrame, runs: Sequence[str]) -> DataFrame:
    return prf.groupBy(*runs).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"))


def metrics_long(prf: DataFrame, runs: Sequence[str], series: str, series_order: Sequence[str],
                 x_min: float = 0.0, x_max: float = 100.0, bar_width: float = 0.4) -> DataFrame:
    """Long ``(runs..., class, metric, value, x)`` table behind a grouped bar chart.

    ``x = linspace(x_min + 2, x_max - 2, k)[class_idx] + bar_width * series_pos``.
    """
    runs = list(runs)
    order = F.array(*[F.lit(s) for s in series_order])
    group = [r for r in runs if r != series]
    k = F.max("class_idx").over(Window.partitionBy(*group, series)) + 1 if group else \
        F.max("class_idx").over(Window.partitionBy(series)) + 1
    lo, hi = x_min + 2.0, x_max - 2.0
    step = F.when(k > 1, (F.lit(hi) - F.lit(lo)) / (k - 1)).otherwise(F.lit(0.0))
    pos = F.array_position(order, F.col(series)) - 1
    long = prf.unpivot(runs + ["class_idx", "class"], ["precision", "recall", "f1"], "metric", "value")
    return long.withColumn("x", F.lit(lo) + F.col("class_idx") * step + F.lit(bar_width) * pos)


def series_stats(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """Mean and population standard deviation of ``value`` per series (error bars)."""
    return df.groupBy(*series).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                   F.stddev_pop(value).alias("std"))


def display_labels(dom: DataFrame, runs: Sequence[str], display: Sequence[str]) -> DataFrame:
    """Map the sorted label domain, by position, to display names.

    Raises when the domain and the display list differ in size (the
    reference silently mislabels in that case).
    """
    names = F.array(*[F.lit(s) for s in display])
    out = (dom.withColumn("_ok", F.size("labels") == F.lit(len(display)))
              .select(*runs, "_ok", F.posexplode("labels").alias("class_idx", "class"))
              .withColumn("display", F.when(F.col("_ok"), F.get(names, F.col("class_idx")))
                          .otherwise(F.raise_error(F.lit("label count differs from display list"))))
              .drop("_ok"))
    return out

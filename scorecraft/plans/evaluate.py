"""End-to-end evaluation jobs over prediction tables holding many runs.

``evaluate_predictions``: raw answers -> cleaning rules -> per-run class
domain -> nearest class (token cosine, or the year regex route) -> processed
rows with ``predicted_class`` and ``correct``.  ``run_report`` derives
accuracy and per-class precision / recall / F1 from one count table.
``classify_features``: zero-shot classification of stored image features
against class vectors (the direct CLIP-style route).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.functions import text as T
from scorecraft.operators import metrics as M
from scorecraft.operators.domains import STYLE_ORDER, UNKNOWN, YEAR_END, YEAR_START, order_table
from scorecraft.operators.encode import token_nearest
from scorecraft.operators.nearest import zero_shot
from scorecraft.operators.ordering import first_n
from scorecraft.operators.rules import canonical_attribute, canonical_model, clean_predictions
from scorecraft.session import bounded_broadcast, cut_lineage

RUN = ["run", "dataset", "attribute", "model"]


def attach_manifest(preds: DataFrame, manifests: DataFrame) -> DataFrame:
    """Results joined to the manifest of the same run folder (prompt etc.).

    Manifests are one row per run: broadcast after a size check.
    """
    m = manifests.select("run", "prompt", "manifest_attribute")
    m, _ = bounded_broadcast(m)
    return preds.join(m, "run", "left")


def run_profiles_from_manifests(manifests: DataFrame) -> list[str] | None:
    """Rule profiles of the runs described by a manifest table (one small row per run)."""
    p = F.coalesce(F.col("prompt"), F.lit(""))
    key = F.concat_ws("|", canonical_model(F.col("model")), canonical_attribute(F.col("attribute")),
                      F.contains(p, F.lit("[author]")).cast("string"), F.contains(p, F.lit("[year]")).cast("string"))
    from scorecraft.operators.rules import run_profiles
    return run_profiles(manifests, key) or None  # None: all branches


def run_domains(preds: DataFrame, year_precision: int = 100) -> DataFrame:
    """``(run, class_idx, class)`` for every run in ``preds``.

    * art_style / period with a known dataset: the chronological list;
    * author: distinct ground truth plus ``unknown``;
    * year: ``range(1400, 2100, precision)``;
    * otherwise: distinct ground truth.
    Every branch works on distinct values only (partial aggregation first).
    """
    spark = preds.sparkSession
    runs = preds.select(*RUN).distinct()
    styled = F.col("attribute").isin("art_style", "period")
    known = F.col("dataset").isin(list(STYLE_ORDER))
    order = order_table(spark).select("dataset", F.col("pos").alias("class_idx"),
                                      T.normalise_label("label").alias("class"))
    ordered = runs.where(styled & known).join(F.broadcast(order), "dataset").select("run", "class_idx", "class")

    years = (runs.where(F.col("attribute") == "year")
                 .select("run", F.posexplode(F.sequence(F.lit(YEAR_START), F.lit(YEAR_END - 1), F.lit(year_precision)))
                         .alias("class_idx", "y"))
                 .select("run", "class_idx", F.col("y").cast("string").alias("class")))

    gts = preds.select("run", "attribute", "dataset", T.normalise_label("gt").alias("class")).distinct()
    extra = runs.where(F.col("attribute") == "author").select("run", "attribute", "dataset",
                                                              F.lit(UNKNOWN).alias("class"))
    rest = (gts.unionByName(extra).distinct()
               .where(~((styled & known) | (F.col("attribute") == "year")))
               .withColumn("class_idx", (F.row_number().over(Window.partitionBy("run").orderBy("class")) - 1)
                           .cast("int"))
               .select("run", "class_idx", "class"))
    return ordered.unionByName(years).unionByName(rest)


def manifest_class_texts(preds: DataFrame, domains: DataFrame) -> DataFrame:
    """Class texts from each run's own prompt: ``[<attribute>]`` replaced by the class.

    The attribute named in the manifest (``manifest_attribute``, else the
    folder's) gives the placeholder.  A run whose prompt lacks it would give
    every class the same text, so the job fails instead of scoring on it.
    """
    attr = (F.coalesce(F.col("manifest_attribute"), F.col("attribute"))
            if "manifest_attribute" in preds.columns else F.col("attribute"))
    prompts = preds.select("run", F.col("prompt"), F.concat(F.lit("["), attr, F.lit("]")).alias("_ph")).distinct()
    prompts, _ = bounded_broadcast(prompts)
    text = (F.when(F.contains(F.coalesce("prompt", F.lit("")), F.col("_ph")),
                   F.replace(F.col("prompt"), F.col("_ph"), F.col("class")))
             .otherwise(F.raise_error(F.concat(F.lit("prompt of run "), F.col("run"),
                                               F.lit(" has no placeholder "), F.col("_ph")))))
    return domains.join(prompts, "run").withColumn("class_text", text).drop("prompt", "_ph")


def _gt_key(gt: Column, attribute: Column, year_precision: int) -> Column:
    return (F.when(attribute.isin("art_style", "period"), T.normalise_label(gt))
             .when(attribute == "year", T.year_bucket(gt, year_precision))
             .otherwise(gt))


def evaluate_predictions(preds: DataFrame, year_precision: int = 100, class_template: str = "{class}",
                         year_route: str = "regex", analyzer: str = "word", checkpoint: bool = False,
                         profiles: list[str] | None = None) -> DataFrame:
    """Processed rows: ``pred_clean``, ``predicted_class``, ``gt_key``, ``correct``.

    ``preds`` needs ``run, dataset, attribute, model, row_idx, gt, preds`` and
    optionally ``prompt`` (from the manifest).  ``class_template`` builds the
    class text (``{class}`` is replaced by the class label); ``"manifest"``
    uses each run's prompt with its ``[<attribute>]`` placeholder instead.
    ``year_route='regex'`` maps year answers with the first-year rule; any
    other value uses the nearest-class route for years too.  ``profiles``
    (see :func:`run_profiles_from_manifests`) spares the profile scan.
    """
    df = preds
    if "prompt" not in df.columns:
        df = df.withColumn("prompt", F.lit(None).cast("string"))
    df = (df.withColumn("model", canonical_model(F.col("model")))
            .withColumn("attribute", canonical_attribute(F.col("attribute"))))
    # Class domains come from distinct values of the input (partial aggregation,
    # no need to wait for the cleaning or to shuffle the answers for them).
    # Kept after the first computation: the size check, the class texts and
    # the label lookup all read it (one scan of the ground-truth column).
    domains = run_domains(df, year_precision).persist(StorageLevel.MEMORY_AND_DISK)
    domains, _ = bounded_broadcast(domains)

    cleaned = clean_predictions(df, "preds", "model", "attribute", "prompt", year_precision, profiles=profiles)
    # Cleaned once: both routes read this copy (memory, spilling to disk).  Every
    # row is answered by itself, so no exchange of the answers is needed.
    # ``checkpoint=True`` writes the cleaned rows to the shared checkpoint folder
    # instead (cuts lineage).
    cleaned = cut_lineage(cleaned) if checkpoint else cleaned.persist(StorageLevel.MEMORY_AND_DISK)

    if class_template == "manifest":
        class_text = manifest_class_texts(df, domains)
    else:
        head, tail = class_template.split("{class}") if "{class}" in class_template else (class_template, "")
        class_text = domains.withColumn("class_text", F.concat(F.lit(head), F.col("class"), F.lit(tail)))
    # Year answers on the regex route need no nearest-class search at all.
    by_regex = (F.col("attribute") == "year") & F.lit(year_route == "regex")
    near = token_nearest(cleaned.where(~by_regex), ["run", "row_idx"], "pred_clean", class_text, "class_idx",
                         "class_text", analyzer, scope=["run"], keep=cleaned.columns)
    # No shared term with any class: every similarity is 0 and the first class wins.
    near = near.withColumn("class_idx", F.coalesce("class_idx", F.lit(0)))
    near = (near.join(domains.select("run", "class_idx", F.col("class").alias("nearest_class")),
                      ["run", "class_idx"], "left")
                .withColumn("predicted_class", F.col("nearest_class")))
    regex = (cleaned.where(by_regex)
                    .withColumn("class_idx", F.lit(None).cast("int"))
                    .withColumn("cosine", F.lit(None).cast("double"))
                    .withColumn("nearest_class", F.lit(None).cast("string"))
                    .withColumn("predicted_class", T.year_bucket(T.find_year("pred_clean"), year_precision)))
    out = near.unionByName(regex)
    out = out.withColumn("gt_key", _gt_key(F.col("gt"), F.col("attribute"), year_precision))
    # A ground-truth year outside the class range can never be predicted by the
    # nearest-class route; flag it instead of silently counting a miss.
    gy = F.col("gt_key").try_cast("int")
    out = out.withColumn("out_of_domain", F.when(F.col("attribute") == "year",
                                                 gy.isNull() | (gy < YEAR_START) | (gy >= YEAR_END)))
    return out.withColumn("correct", F.coalesce(F.col("predicted_class") == F.col("gt_key"), F.lit(False)))


def run_report(processed: DataFrame, pred_col: str = "predicted_class", gt_col: str = "gt_key",
               domains: DataFrame | None = None, year_precision: int = 100) -> dict[str, DataFrame]:
    """Accuracy, per-class P/R/F1 (labels = sorted distinct gt) and confusion, from one count table.

    The confusion is over the run's class list (``domains``: run, class_idx, class; by default
    ``run_domains`` of the rows), with what lies outside it under a NULL label.
    """
    counts = M.pair_counts(processed, RUN, gt_col, pred_col)
    prf = M.precision_recall_f1(M.class_stats(counts, RUN))
    domains = domains if domains is not None else run_domains(processed, year_precision)
    listed, _ = bounded_broadcast(counts.select(*RUN).distinct())
    return {"accuracy": M.accuracy(counts, RUN), "prf": prf, "macro": M.macro_average(prf, RUN),
            "confusion": M.confusion_over(counts, RUN, domains.join(listed, "run").select(*RUN, "class_idx", "class"))}


def classify_features(annotations: DataFrame, features: DataFrame, classes: DataFrame, attribute: str,
                      logit_scale: float = 100.0, n: int = -1) -> DataFrame:
    """Zero-shot classification of stored image features (direct route).

    ``annotations`` (file, <attribute>, ...) joins ``features`` (file, features)
    on the file key; ``classes`` holds ``class_idx, class_label, class_vec``.
    ``n >= 0`` keeps the first n annotation rows: in file order where the annotations
    have their place (``pos``, from ``read_annotations``), else in key order.
    """
    order = "pos" if "pos" in annotations.columns else "file"
    ann = first_n(annotations.select("file", *([order] if order != "file" else []), T.normalise_label(attribute).alias("gt")), order, n)
    ann = ann.select("file", "gt")
    items = ann.join(features.select("file", "features"), "file")
    return zero_shot(items, "features", "gt", classes, logit_scale)


def load_runs(spark: SparkSession, results_root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw predictions, processed predictions, manifests) of every run folder under ``results_root``."""
    from scorecraft.sources.files import read_manifests, read_predictions, read_processed
    root = results_root.rstrip("/")
    return (read_predictions(spark, f"{root}/*/results.csv"),
            read_processed(spark, f"{root}/*/results_processed.csv"),
            read_manifests(spark, f"{root}/*/args.json"))


def model_report(raw: DataFrame, processed: DataFrame, dataset: str, attribute: str = "art_style",
                 key: str = "lower", display: list[str] | None = None) -> dict[str, DataFrame]:
    """Comparison of every model's run for one dataset and attribute (report scripts).

    Per run, processed answers (``predicted_class``) win over raw ones.  Labels
    are normalised with ``key='lower'`` (P/R/F1 report) or ``'underscore'``
    (confusion report); the class list is the sorted distinct gt of each run,
    optionally mapped by position to ``display`` names.
    """
    from scorecraft.sources.files import preferred_results
    norm = T.report_key_lower if key == "lower" else T.report_key_underscore
    runs = ["run", "dataset", "attribute", "model"]  # one row per run: conditioned runs are not pooled with their base run
    chosen = (preferred_results(raw, processed)
              .where((F.col("dataset") == dataset) & (F.col("attribute") == attribute))
              .select(*runs, norm("gt").alias("gt"), norm("pred").alias("pred")))
    counts = M.pair_counts(chosen, runs)
    stats = M.class_stats(counts, runs)
    out = {"accuracy": M.accuracy(counts, runs), "prf": M.precision_recall_f1(stats),
           "confusion": M.confusion_long(counts, runs)}
    if display is not None:
        out["labels"] = M.display_labels(M.label_domain(counts, runs, "gt"), runs, display)
    return out

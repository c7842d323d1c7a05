"""Data audits: unmatched keys, label disagreements, missing results, manifest drift.

All are anti/semi joins or small aggregations over the same inputs the
evaluation reads; each returns a DataFrame of findings (never a driver list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.text import normalise_label
from scorecraft.operators.rules import canonical_attribute

# Attribute names that all mean the art style.
STYLE_NAMES = ("style", "art_style", "period")


def unmatched_files(results: DataFrame, annotations: DataFrame, result_key: str = "images",
                    annotation_key: str = "file") -> DataFrame:
    """AU1: keys present on one side only (both directions), tagged by side."""
    r = results.select(F.col(result_key).alias("key")).distinct()
    a = annotations.select(F.col(annotation_key).alias("key")).distinct()
    return (r.join(a, "key", "left_anti").withColumn("side", F.lit("results_only"))
            .unionByName(a.join(r, "key", "left_anti").withColumn("side", F.lit("annotations_only"))))


def gt_disagreements(results: DataFrame, annotations: DataFrame, attribute: str,
                     result_key: str = "images", annotation_key: str = "file") -> DataFrame:
    """AU2: stored ground truth differs from the (normalised) annotation value."""
    ann = annotations.select(F.col(annotation_key).alias(result_key),
                             normalise_label(attribute).alias("annotated"))
    return (results.join(ann, result_key)
                   .where(~normalise_label("gt").eqNullSafe(F.col("annotated"))))


def runs_without_results(manifests: DataFrame, results: DataFrame) -> DataFrame:
    """AU3: runs that have a manifest but no result rows."""
    return manifests.select("run").distinct().join(results.select("run").distinct(), "run", "left_anti")


def manifest_attribute_drift(manifests: DataFrame) -> DataFrame:
    """AU4: the manifest's attribute contradicts the run folder (after aliasing)."""
    def norm(c):
        return F.when(c.isin(*STYLE_NAMES), F.lit("art_style")).otherwise(canonical_attribute(c))
    return manifests.where(norm(F.col("manifest_attribute")) != norm(F.col("attribute"))) \
        .select("run", "attribute", "manifest_attribute")

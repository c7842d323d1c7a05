"""Class domains: the closed label set a prediction is mapped onto.

A domain is a small DataFrame ``(class_idx INT, class STRING)``; all builders
derive it with distributed ``distinct``/``groupBy`` (partial aggregation), so
only the distinct labels move, never the facts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.functions.text import normalise_label

# ---------------------------------------------------------------------------
# Chronological style order per dataset and the display names
# used on report axes (aligned by position with the sorted labels).
# ---------------------------------------------------------------------------

STYLE_ORDER = {
    "WikiArt": [
        "Early_Renaissance", "Northern_Renaissance", "High_Renaissance", "Mannerism_Late_Renaissance",
        "Baroque", "Rococo", "Romanticism", "Ukiyo_e", "Realism", "Impressionism", "Pointillism",
        "Post_Impressionism", "Symbolism", "Art_Nouveau_Modern", "Fauvism", "Analytical_Cubism", "Cubism",
        "Synthetic_Cubism", "Expressionism", "Naive_Art_Primitivism", "Abstract_Expressionism", "Action_painting",
        "Color_Field_Painting", "New_Realism", "Pop_Art", "Minimalism", "Contemporary_Realism",
    ],
    "JenAesthetics": [
        "Renaissance", "Mannerism", "Baroque", "Classicism", "Rococo", "Romanticism", "Realism", "Impressionism",
        "Post_Impressionism", "Symbolism", "Expressionism",
    ],
    "ArTest": [
        "Early Renaissance", "High Renaissance", "Mannerism Late Renaissance", "Northern Renaissance",
        "Baroque", "Rococo", "Neo Classicism", "Romanticism", "Realism", "Ukiyo-E", "Impressionism",
        "Post Impressionism", "Symbolism", "Art Nouveau", "Fauvism", "Cubism", "Analytical Cubism",
        "Synthetic Cubism", "Expressionism", "Naive Art Primitivism", "Surrealism", "Abstract Expressionism",
        "Color Field Painting", "Minimalism", "Pop Art",
    ],
}

DISPLAY_LABELS = {
    "WikiArt": [
        "Abstract Expression.", "Action Painting", "Analytical Cubism", "Art Nouveau Modern", "Baroque",
        "Color Field Painting", "Contemporary Realism", "Cubism", "Early Renaissance", "Expressionism",
        "Fauvism", "High Renaissance", "Impressionism", "Mannerism Late Renaiss.", "Minimalism",
        "Naive Art Primitivism", "New Realism", "Northern Renaissance", "Pointillism", "Pop Art",
        "Post-Impressionism", "Realism", "Rococo", "Romanticism", "Symbolism", "Synthetic Cubism", "Ukiyo-E",
    ],
    "JenAesthetics": [
        "Baroque", "Classicism", "Expressionism", "Impressionism", "Mannerism", "Post-Impression.",
        "Realism", "Renaissance", "Rococo", "Romanticism", "Symbolism",
    ],
    "ArTest": [
        "Abstract Expression.", "Analytical Cubism", "Art Nouveau", "Baroque", "Color Field Painting",
        "Cubism", "Early Renaissance", "Expressionism", "Fauvism", "High Renaissance", "Impressionism",
        "Mannerism Late Renaiss.", "Minimalism", "Naive Art Primitivism", "Neo Classicism",
        "Northern Renaissance", "Pop Art", "Post-Impression.", "Realism", "Rococo", "Romanticism",
        "Surrealism", "Symbolism", "Synthetic Cubism", "Ukiyo-E",
    ],
}

UNKNOWN = "unknown"
YEAR_START, YEAR_END = 1400, 2100


def _indexed(df: DataFrame, col: str) -> DataFrame:
    return (df.select(F.col(col).alias("class")).where(F.col("class").isNotNull()).distinct()
              .withColumn("class_idx", (F.row_number().over(Window.orderBy("class")) - 1).cast("int"))
              .select("class_idx", "class"))


def sorted_domain(df: DataFrame, col: str, normalise: bool = True) -> DataFrame:
    """Distinct (normalised) labels, sorted, indexed from 0 (over all rows)."""
    c = normalise_label(col) if normalise else F.col(col)
    return _indexed(df.select(c.alias("_l")), "_l")


def domain_with_unknown(df: DataFrame, col: str, normalise: bool = True) -> DataFrame:
    """Distinct labels plus ``unknown`` (author runs), sorted."""
    c = normalise_label(col) if normalise else F.col(col)
    labels = df.select(c.alias("_l")).union(df.sparkSession.range(1).select(F.lit(UNKNOWN).alias("_l")))
    return _indexed(labels, "_l")


def year_domain(spark: SparkSession, precision: int = 100, start: int = YEAR_START,
                end: int = YEAR_END) -> DataFrame:
    """``range(start, end, precision)`` as text classes."""
    return (spark.range(start, end, precision)
                 .select(((F.col("id") - start) / precision).cast("int").alias("class_idx"),
                         F.col("id").cast("string").alias("class")))


def order_table(spark: SparkSession, orders: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Lookup ``(dataset, pos, label)`` from fixed per-dataset orders."""
    orders = orders or STYLE_ORDER
    rows = [(ds, i, lab) for ds, labs in orders.items() for i, lab in enumerate(labs)]
    return spark.createDataFrame(rows, "dataset string, pos int, label string")


def ordered_domain(spark: SparkSession, dataset: str,
                   orders: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Chronological domain of a dataset; unknown datasets raise."""
    orders = orders or STYLE_ORDER
    if dataset not in orders:
        raise KeyError(f"no chronological order for dataset {dataset!r}")
    return (order_table(spark, {dataset: orders[dataset]})
            .select(F.col("pos").alias("class_idx"), normalise_label("label").alias("class")))


def class_prompts(domain: DataFrame, prompt: str, attribute: str | None = None) -> DataFrame:
    """Prompt per class: placeholder form ``[attribute]`` or suffix form.

    Raises when a placeholder is requested but missing in the prompt, since
    every class would then get the same text.
    """
    if attribute is not None:
        ph = f"[{attribute}]"
        if ph not in prompt:
            raise ValueError(f"prompt has no {ph} placeholder; all class prompts would be equal")
        text = F.replace(F.lit(prompt), F.lit(ph), F.col("class"))
    else:
        text = F.concat(F.lit(prompt), F.col("class"))
    return domain.withColumn("class_prompt", text)


def display_table(spark: SparkSession, dataset: str) -> DataFrame:
    labs = DISPLAY_LABELS[dataset]
    return spark.createDataFrame([(i, s) for i, s in enumerate(labs)], "class_idx int, display string")

"""Readers for annotation tables, prediction files, run manifests and images.

All readers take explicit schemas (no inference pass over the data) and
accept globs, so one scan covers every run folder; the run identity comes
from each file's path via the ``_metadata`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.operators.rules import canonical_attribute, canonical_model
from scorecraft.sources.records import parse_records, read_records

ANNOTATION_SCHEMA = "art_style string, author string, title string, year int, link string, file string"
PREDICTION_SCHEMA = "row_idx bigint, images string, gt string, preds string"
# A row without one of these cannot be scored; it is a reject.
PREDICTION_KEYS, ANNOTATION_KEYS = ("row_idx", "images"), ("file",)
PROCESSED_SCHEMA = ("row_idx0 bigint, row_idx bigint, images string, gt string, preds string, "
                    "predicted_class string")
MANIFEST_SCHEMA = (
    "dataset_name string, attribute string, prompt string, n bigint, image_model string, "
    "text_model string, path_example_image1 string, path_example_image2 string, "
    "max_new_tokens bigint, annotation_dir string, n_classes bigint, epochs bigint, "
    "random_seed bigint, lr double, lr_scheduler_gamma double, results_dir string, "
    "year_precision bigint, image_folder_path string, annotation_file string, features_dir string")


# Only for streams, which read small files as they land; a file is one task there.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def read_rows(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of quoted CSV files with a header, each file read by many tasks.

    Rows have ``source_file`` and ``pos`` (the row's number in its file, from 0) beside the columns
    of ``schema``.  Rejects (source_file, pos, record) are records that do not fit the schema, and rows
    without one of the ``keys``; their ``record`` is the text, or the values joined by commas.
    """
    parsed = parse_records(read_records(spark, path), schema)
    fields = [f for f in parsed.columns if f not in ("source_file", "pos", "_bad")]
    good = F.col("_bad").isNull()
    for k in keys:
        good = good & F.col(k).isNotNull()
    text = F.coalesce("_bad", F.array_join(F.array(*[F.col(f).cast("string") for f in fields]), ",", ""))
    return parsed.where(good).drop("_bad"), parsed.where(~good).select("source_file", "pos", text.alias("record"))


def read_annotations(spark: SparkSession, path: str, schema: str = ANNOTATION_SCHEMA) -> DataFrame:
    """Annotation rows, with their place in the file as ``pos``; ``rejected_rows`` gives what does not fit."""
    return read_rows(spark, path, schema, ANNOTATION_KEYS)[0].drop("source_file")


def _folder(path_col: Column) -> Column:
    """Name of the folder holding the file; the path of ``_metadata`` is percent-encoded."""
    name = F.element_at(F.split(path_col, "/"), -2)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def run_identity(folder: ColumnOrStr) -> dict[str, Column]:
    """``<dataset>_<attribute>[Given<Author|Year|AuthorAndYear>]_<model>``."""
    f = F.col(folder) if isinstance(folder, str) else folder
    dataset = F.split_part(f, F.lit("_"), F.lit(1))
    model = F.substring_index(f, "_", -1)
    middle = F.regexp_extract(f, r"^[^_]*_(.*)_[^_]*$", 1)
    attr_raw = F.split_part(middle, F.lit("Given"), F.lit(1))
    given = F.split_part(middle, F.lit("Given"), F.lit(2))
    return {
        "dataset": dataset,
        "attribute_raw": attr_raw,
        "attribute": canonical_attribute(attr_raw),
        "given_author": F.contains(given, F.lit("Author")),
        "given_year": F.contains(given, F.lit("Year")),
        "model": canonical_model(model),
        "run": f,
    }


ColumnOrStr = Column | str


def with_run(df: DataFrame, path: str = "_metadata.file_path") -> DataFrame:
    ident = run_identity(_folder(F.col(path)))
    return df.select("*", *[v.alias(k) for k, v in ident.items()])


def read_predictions(spark: SparkSession, path_glob: str) -> DataFrame:
    """Raw prediction files (multi-line quoted answers) with run columns and ``pos``."""
    return with_run(read_rows(spark, path_glob, PREDICTION_SCHEMA, PREDICTION_KEYS)[0], "source_file").drop("source_file")


def read_processed(spark: SparkSession, path_glob: str) -> DataFrame:
    rows = read_rows(spark, path_glob, PROCESSED_SCHEMA, PREDICTION_KEYS)[0]
    return with_run(rows, "source_file").drop("row_idx0", "source_file")


def rejected_rows(spark: SparkSession, path_glob: str, schema: str = PREDICTION_SCHEMA, keys: tuple[str, ...] = PREDICTION_KEYS) -> DataFrame:
    """Records of the files that the readers leave out: run columns, source_file, pos, record."""
    return with_run(read_rows(spark, path_glob, schema, keys)[1], "source_file")


def read_manifests(spark: SparkSession, path_glob: str) -> DataFrame:
    """One row per run manifest; keys missing in a file are NULL.

    The manifest's own ``attribute`` is kept as ``manifest_attribute``; the
    run columns (from the folder name) take precedence.
    """
    df = (spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path_glob)
               .withColumnRenamed("attribute", "manifest_attribute"))
    return with_run(df)


def read_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, file, content)`` image bytes; ``file`` is the path relative to ``folder``."""
    root = folder.rstrip("/") + "/"
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
               .option("recursiveFileLookup", "true").load(root))
    # \Q...\E quotes the folder literally in the (Java) pattern.
    return df.select("path", F.regexp_replace("path", "^.*?\\Q" + root + "\\E", "").alias("file"), "content")


def prefer_processed(raw: DataFrame, processed: DataFrame, run_keys: list[str]) -> DataFrame:
    """Per run, the processed rows when that run has any, else its raw rows.

    The decision is made on the (small) set of runs present in ``processed``:
    raw rows are kept by a broadcast anti-join on the run keys, so no window
    or shuffle ever groups the fact rows of one run into one task.
    """
    from scorecraft.session import bounded_broadcast
    runs, _ = bounded_broadcast(processed.select(*run_keys).distinct())
    kept_raw = raw.join(runs, run_keys, "left_anti")
    return (processed.withColumn("source", F.lit("processed"))
            .unionByName(kept_raw.withColumn("source", F.lit("raw"))))


def preferred_results(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Processed files (``predicted_class``) win over raw files (``preds``) per run."""
    cols = ["run", "dataset", "attribute", "model", "row_idx", "images", "gt"]
    return prefer_processed(raw.select(*cols, F.col("preds").alias("pred")),
                            processed.select(*cols, F.col("predicted_class").alias("pred")), ["run"])

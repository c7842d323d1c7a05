"""Writers: prediction / processed tables, run manifests, feature tables.

Outputs are Parquet partitioned by run identity, so a report over one run
prunes every other run's files.  Writes are idempotent per partition
(dynamic partition overwrite), which keeps retried jobs and lost executors
from duplicating rows.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from scorecraft.sources.files import MANIFEST_SCHEMA

RUN_PARTITIONS = ["dataset", "attribute", "model"]


def write_runs(df: DataFrame, path: str, partitions: list[str] = RUN_PARTITIONS) -> None:
    """Write runs, replacing only the partitions that ``df`` holds.

    The ``run`` key, where present, is the last partition level: runs that differ
    only in their conditioning (given author or year) do not replace each other.
    """
    keys = [*partitions, *(["run"] if "run" in df.columns and "run" not in partitions else [])]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def run_name(args: dict[str, Any]) -> str:
    """Folder name of a run's results: dataset, attribute and model."""
    return "_".join(str(args.get(k) or "none") for k in ("dataset_name", "attribute", "image_model"))


def manifest_row(spark: SparkSession, args: dict[str, Any], run: str | None = None) -> DataFrame:
    """One-row DataFrame of a run's parameters.

    The columns are always those of ``MANIFEST_SCHEMA``, NULL where the run has no such
    parameter, and ``run``; ``args_json`` holds all parameters, those that have no column too.
    """
    schema = _parse_datatype_string(MANIFEST_SCHEMA)
    held = json.dumps({k: v for k, v in args.items() if k in schema.fieldNames()})
    row = spark.createDataFrame([(run or run_name(args), held, json.dumps(args, indent=4))], "run string, _held string, args_json string")
    return row.withColumn("_a", F.from_json("_held", MANIFEST_SCHEMA)).select("_a.*", "args_json", "run")


def append_manifest(spark: SparkSession, args: dict[str, Any], path: str, run: str | None = None) -> None:
    """Put a run's manifest in the table: its own partition is replaced, so a retried write leaves one row."""
    manifest_row(spark, args, run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def feature_file_name(file_col: str = "file"):
    """Basename with ``.jpg`` replaced by ``.pt`` (feature naming)."""
    return F.replace(F.element_at(F.split(F.col(file_col), "/"), -1), F.lit(".jpg"), F.lit(".pt"))


def write_features(df: DataFrame, path: str, file_col: str = "file", vec_col: str = "features") -> None:
    (df.select(F.col(file_col), feature_file_name(file_col).alias("feature_file"), F.col(vec_col))
       .write.mode("overwrite").parquet(path))


def write_requests(df: DataFrame, path: str, json_col: str = "request_json") -> None:
    """JSON-lines request batch (one request per line)."""
    df.select(json_col).write.mode("overwrite").text(path)

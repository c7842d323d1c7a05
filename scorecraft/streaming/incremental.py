"""Incremental scoring: prediction files are scored as they land in a folder.

The same operators as the batch job run on a file stream: answers are
cleaned row by row, reduced to the ``(run, gt, pred, n)`` count table in
Spark's state store, and accuracy per run is re-derived from that state on
every micro-batch.  State holds one row per (run, gt, pred), never the
answers themselves, so it stays small however many files arrive.  Progress
is kept in a checkpoint under the cluster's shared ``spark.checkpoint.dir``,
so a restarted query (or a lost executor) resumes without double counting.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorecraft.functions.text import report_key_lower
from scorecraft.operators.rules import clean_predictions
from scorecraft.session import checkpoint_dir
from scorecraft.sources.files import PREDICTION_SCHEMA, _CSV, with_run

RUN = ["run", "dataset", "attribute", "model"]


def prediction_stream(spark: SparkSession, results_root: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming rows of every ``<run folder>/results.csv`` under ``results_root``."""
    df = (spark.readStream.options(**_CSV).option("maxFilesPerTrigger", max_files_per_trigger)
               .schema(PREDICTION_SCHEMA).csv(f"{results_root.rstrip('/')}/*/results.csv"))
    return with_run(df)


def running_counts(preds: DataFrame, clean: bool = False, profiles: list[str] | None = None) -> DataFrame:
    """Streaming ``(run..., gt, pred, n)``; optionally clean raw answers first.

    Profile detection needs a batch pass, so a stream cleans with the given
    ``profiles`` (or with every rule branch when none are given).
    """
    df = preds
    if clean:
        df = (df.withColumn("prompt", F.lit(None).cast("string"))
                .transform(lambda d: clean_predictions(d, profiles=profiles, detect_profiles=False))
                .withColumn("preds", F.col("pred_clean")))
    return (df.select(*RUN, report_key_lower("gt").alias("gt"), report_key_lower("preds").alias("pred"))
              .groupBy(*RUN, "gt", "pred").agg(F.count(F.lit(1)).alias("n")))


def running_accuracy(counts: DataFrame) -> DataFrame:
    """Accuracy per run over a (streaming) count table."""
    hit = F.when(F.col("gt").isNotNull() & F.col("pred").eqNullSafe(F.col("gt")), F.col("n")).otherwise(0)
    return (counts.groupBy(*RUN).agg(F.sum("n").alias("n"), F.sum(hit).alias("correct"))
                  .withColumn("accuracy", F.col("correct") / F.col("n") * 100.0))


def start_scoring(spark: SparkSession, results_root: str, output: str, name: str = "scores",
                  clean: bool = False, available_now: bool = True,
                  checkpoint_location: str | None = None) -> StreamingQuery:
    """Run the incremental count table and rewrite accuracy per run each micro-batch.

    The count table is the stateful part (complete mode); each batch writes
    the accuracy table with ``overwrite`` -- idempotent if a batch is replayed.
    The query's progress lives in ``checkpoint_location`` (default:
    ``<spark.checkpoint.dir>/stream-<name>``): restarting with the same name
    resumes where it stopped, files already counted are not counted again.
    """
    counts = running_counts(prediction_stream(spark, results_root), clean=clean)
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), f"stream-{name}")

    def publish(batch: DataFrame, epoch_id: int) -> None:
        running_accuracy(batch).write.mode("overwrite").parquet(output)

    writer = (counts.writeStream.outputMode("complete").queryName(name)
                    .option("checkpointLocation", ckpt).foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()

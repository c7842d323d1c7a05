"""Session defaults, checkpoint location and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults chosen for a large cluster; tests and bench override the
# partition count for local mode.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Upper bound on rows of a side we are willing to broadcast (class domains,
# rule tables, manifests).  Checked at runtime with ``bounded_broadcast``.
MAX_BROADCAST_ROWS = 200_000


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "scorecraft") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent and Spark runs in local mode (tests) do we
    pick a scratch folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            # A machine-local folder is not visible to other executors.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        d = tempfile.mkdtemp(prefix="scorecraft-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bound_holds(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Runs ``limit(max_rows + 1).count()``: Spark stops reading once the limit
    is reached, so the check costs at most ``max_rows + 1`` rows.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when its row count is proven to be small.

    Returns the (possibly hinted) frame and whether the hint was applied, so
    callers can choose a shuffle-based plan beyond the bound.
    """
    if row_bound_holds(df, max_rows):
        return F.broadcast(df), True
    return df, False


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default


# Target bytes per task after a repartition of text-heavy rows.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024
MAX_PARTITIONS = 200_000


def suggested_partitions(df: DataFrame, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for hash-partitioning ``df``: Spark's size estimate / target.

    Uses the optimizer's statistics (file sizes scaled by the pruned columns),
    never the data itself; at least ``spark.sql.shuffle.partitions``.
    """
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 -- statistics are advisory
        return base
    unknown = int(spark.conf.get("spark.sql.defaultSizeInBytes", str(2 ** 63 - 1)))
    # a projection of a table of unknown size is some fraction of the default (2 ** 63 - 1: 8 million TB)
    if size <= 0 or size >= unknown // 1000:
        return base
    return int(min(max(base, -(-size // target_bytes)), MAX_PARTITIONS))

"""First-n rows in key order (LIM1) without funnelling large n through one task.

Small n: Spark's top-k (each task keeps its n best rows, one merge of
n x tasks rows).  Large n: the rows are range-partitioned and sorted by the
key, written once to the shared checkpoint folder (so partition ids stay
fixed), the per-partition row counts are read (one small row per
partition), and every partition before the cut is kept whole while the
partition holding the cut keeps its first rows -- all in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.session import cut_lineage

TOP_K_MAX = 100_000


def first_n(df: DataFrame, key: str, n: int, top_k_max: int = TOP_K_MAX) -> DataFrame:
    """Rows with the ``n`` smallest keys (``n < 0``: all rows)."""
    if n < 0:
        return df
    if n <= top_k_max:
        return df.orderBy(key).limit(n)
    ranged = cut_lineage(df.repartitionByRange(key).sortWithinPartitions(key)
                           .withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    whole, cut_part, cut_rows, seen = [], None, 0, 0
    for part, count in sizes:
        if seen + count <= n:
            whole.append(part)
            seen += count
        else:
            cut_part, cut_rows = part, n - seen
            break
    kept = ranged.where(F.col("_part").isin(whole)) if whole else ranged.limit(0)
    if cut_part is not None and cut_rows > 0:
        w = Window.partitionBy("_part").orderBy(key)
        head = (ranged.where(F.col("_part") == cut_part).withColumn("_rn", F.row_number().over(w))
                      .where(F.col("_rn") <= cut_rows).drop("_rn"))
        kept = kept.unionByName(head)
    return kept.drop("_part")

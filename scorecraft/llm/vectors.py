"""Vectors as packed bytes, and the work units of a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, nonzero: bool) -> tuple[DataFrame, int]:
    """(vec_id, vec) of the vectors that take part, and their dimension.

    Out are NULL ids and vectors, NULL or non-finite components, zero vectors if
    ``nonzero``, and vectors that have not the most frequent dimension (of equally
    frequent ones the smallest).  Rows that are alike in both count once; rows of one id
    with different vectors all count.  Other columns are not read.
    """
    x = F.col("vec")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    if nonzero:
        ok = ok & F.exists(x, lambda v: v != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(ok)
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dim = common["d"] if common else 0
    return rows.where(F.size(x) == dim).distinct(), dim


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def packed(column: pa.ChunkedArray | pa.Array, dtype, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def pack(rows: DataFrame, dim: int, turn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(vec_id, norm, data): ``turn`` maps a matrix of vectors to (matrix to keep, one norm a row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, norm = turn(matrix(batch.column("vec"), dim))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "norm": pa.array(norm.astype(np.float64)),
                "data": pa.array([r.tobytes() for r in kept], pa.binary())})

    return rows.mapInArrow(run, "vec_id long, norm double, data binary")


def search_blocks(items: DataFrame, queries: DataFrame, spans: list[tuple[int, int, float]], n_query_blocks: int,
                  search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``search(items, queries)`` on every pair of an item block and a query block.

    Both frames have an int ``block`` (of items) or ``query_block`` (of queries).
    Each unit holds one block of either side, so its memory is bounded whatever
    the tables hold.  ``spans``, a bounded list, holds runs of item blocks: (first, number,
    reach); a query (with columns ``norm`` and ``least``) goes only to those with
    norm * reach >= least.
    """
    left = items.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_query_blocks - 1)))))
    runs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(a + n - 1).alias("b"), F.lit(float(r)).alias("reach")) for a, n, r in spans])
    to = F.filter(runs, lambda r: F.col("norm") * r["reach"] >= F.col("least"))
    right = queries.withColumn("block", F.explode(F.flatten(F.transform(to, lambda r: F.sequence(r["a"], r["b"])))))
    return left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(search, schema)


def best_of(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's finds (``query_row``: one row of the queries), ties to the smaller vec_id."""
    order = F.desc("score") if descending else F.asc("score")
    w = Window.partitionBy("query_id", "query_row").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

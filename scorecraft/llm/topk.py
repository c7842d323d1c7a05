"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length.  In a bucket, a query needs a cosine of at least
its threshold divided by both lengths; where that local threshold is above 1
the bucket is skipped, where it is low only the lengths prune (a prefix of the
bucket in order of length), and where it is high the coordinates prune: with a
cosine of t, unit vectors differ in a coordinate by a bounded amount, so the
query's largest coordinates each leave an interval of the bucket's.  Whatever
is left is verified by its exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stored
from scorecraft.llm.vectors import best_of, pack, packed, search_blocks, valid_vectors

SCALE = 256
BLOCK, QUERY_BLOCK, CLASSES = 2048, 1024, 256
# From this local cosine threshold on, coordinates prune; below it, lengths.
COORDINATE_FROM = 0.5
FOCUS = 4
# First thresholds come from this many of the longest vectors.
PROBE = 512
# Slack for rounding: bounds are loosened by it, products are exact.
EPS = 1e-9
SCHEMA = "query_id long, query_row long, vec_id long, score long"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = np.floor(SCALE * x)
    norm = np.sqrt((whole ** 2).sum(axis=1))
    # a product is at most the product of two lengths
    if not (norm < 2.0 ** 31.5 * (1 - 1e-9)).all():
        raise OverflowError("vectors so long that an inner product may be beyond 64 bits")
    return whole.astype(np.int64), norm


class Bucket:
    """Vectors in falling order of length, with their unit vectors' coordinates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.x, self.norm = ids[order], x[order], norm[order]
        self.unit = self.x / np.maximum(self.norm, 1e-300)[:, None]
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.by_coordinate:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.by_coordinate[f] = order, self.unit[order, f]
        return self.by_coordinate[f]

    def candidates(self, q: np.ndarray, q_norm: float, least: float) -> np.ndarray:
        """Rows whose product with q may reach ``least``."""
        if not np.isfinite(least) or least <= 0 or q_norm == 0 or not self.norm[0]:
            return np.arange(len(self.ids))
        local = least / (q_norm * self.norm[0])
        if local > 1 + EPS:
            return np.zeros(0, np.int64)
        # falling lengths: those that can reach the threshold at all are a prefix
        end = int(np.searchsorted(-self.norm, -(least / q_norm) * (1 - EPS), side="right"))
        if local < COORDINATE_FROM:
            return np.arange(end)
        # cos >= t leaves |u_f - t' u_q| bounded: u_f in [t a - s, a' + s] with s = sqrt((1 - t^2)(1 - a^2))
        u, t = q / q_norm, min(1.0, local)
        best = None
        focus = np.argsort(-np.abs(u))[:FOCUS]
        spans = []
        for f in focus:
            a = u[f]
            slack = np.sqrt(max(0.0, (1 - t * t) * (1 - a * a)))
            low = -1.0 if a <= -t else t * a - slack
            high = 1.0 if a >= t else t * a + slack
            order, value = self._sorted(int(f))
            i, j = np.searchsorted(value, low - EPS), np.searchsorted(value, high + EPS, side="right")
            spans.append((int(f), low - EPS, high + EPS))
            if best is None or j - i < best[0]:
                best = j - i, order[i:j]
        rows = best[1]
        rows = rows[rows < end]
        for f, low, high in spans:
            v = self.unit[rows, f]
            rows = rows[(v >= low) & (v <= high)]
        return rows

    def top(self, q: np.ndarray, q_id: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(q.astype(np.float64), float(np.sqrt((q.astype(np.float64) ** 2).sum())), least)
        score = self.x[rows] @ q
        ids = self.ids[rows]
        ok = (ids != q_id) & (score >= least)
        score, ids = score[ok], ids[ok]
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            score, ids = score[score >= cut], ids[score >= cut]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def top_products(table: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` highest products.

    Score is the exact inner product of the components floor(256 x); vectors so long that one
    could be beyond 64 bits are an error.  Ties go to the smaller vec_id; rows of the query's own
    vec_id are excluded; all candidates if there are fewer than ``k``.  A repeated vec_id with
    different vectors gives several candidates, and as many queries.  Which vectors
    take part is told in ``valid_vectors`` (zero vectors do).  A table without
    valid vectors gives no rows.
    """
    rows, dim = valid_vectors(table, nonzero=False)
    items = stored(pack(rows, max(dim, 1), quantised), "topk")
    n = items.count()
    queries = items.where(F.col("vec_id") % every == 0)
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int")).withColumn("row", F.xxhash64("vec_id", "data"))

    # Buckets: classes of length between quantiles, each cut by hash into blocks of bounded size.
    n_classes = max(1, min(CLASSES, -(-n // block)))
    steps = [i / n_classes for i in range(1, n_classes)]
    cuts = sorted(set(items.agg(F.percentile_approx("norm", steps, 10_000)).first()[0] or [])) if steps and n else []
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    classed = items.withColumn("class", F.size(F.filter(edges, lambda c: c < F.col("norm"))))
    sizes = {r["class"]: (r["n"], r["top"]) for r in classed.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}  # at most CLASSES rows
    spans = []
    for c in range(len(cuts) + 1):
        rows_in, top = sizes.get(c, (0, 0.0))
        at = sum(spans[-1][:2]) if spans else 0
        spans.append((at, max(1, -(-rows_in // block)), top * (1 + EPS)))
    first, parts = [s[0] for s in spans], [s[1] for s in spans]
    at = F.col("class") + 1
    spread = classed.withColumn("block", (
        F.element_at(F.array(*map(F.lit, first)), at)
        + F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*map(F.lit, parts)), at).cast("long"))).cast("int")).drop("class", "norm")

    # First thresholds: the k-th best product with the longest vectors (any other k rows can only raise it).
    ids = [r[0] for r in items.select("vec_id", "norm").orderBy(F.desc("norm"), "vec_id").limit(PROBE).collect()]
    longest = items.where(F.col("vec_id").isin(ids)).collect() if ids else []  # at most PROBE rows
    probe = Bucket(np.array([r["vec_id"] for r in longest], np.int64),
                   np.frombuffer(b"".join(r["data"] for r in longest), np.int64).reshape(len(longest), max(dim, 1))) if longest else None
    shared = table.sparkSession.sparkContext.broadcast(probe)

    def threshold(batches):
        for batch in batches:
            q, ids = packed(batch.column("data"), np.int64, max(dim, 1)), batch.column("vec_id").to_numpy()
            least = np.full(len(q), -np.inf)
            scores = q @ shared.value.x.T
            scores[ids[:, None] == shared.value.ids[None, :]] = np.iinfo(np.int64).min
            if scores.shape[1] > k:
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    asked = asked.mapInArrow(threshold, "vec_id long, norm double, data binary, query_block int, row long, least double")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            bucket = Bucket(left["vec_id"].to_numpy(), packed(left["data"], np.int64, dim))
            q, q_ids, least = packed(right["data"], np.int64, dim), right["vec_id"].to_numpy(), right["least"].to_numpy()
            q_rows = right["row"].to_numpy()
            for i in range(len(q)):
                who, score = bucket.top(q[i], int(q_ids[i]), float(least[i]), k)
                out.append((np.full(len(who), q_ids[i]), np.full(len(who), q_rows[i]), who, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_row", "vec_id", "score"), cols, strict=True)})

    return best_of(search_blocks(spread, asked, spans, n_query_blocks, search, SCHEMA), k, True)

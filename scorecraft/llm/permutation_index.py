"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order of distance.  Each block
of vectors keeps an inverted file per pivot: which vectors have it, and at what
place.  A query reads the files of its own pivots, ranks the block's vectors by
the footrule distance of the two orders, and the best are reranked by their
exact distance.  Every vector is indexed; no candidate list is cut other than by
the share that is reranked, which is what makes the search approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import ragged_index, stored
from scorecraft.llm.vectors import best_of, pack, packed, search_blocks, valid_vectors

#: So many pivots, drawn farthest-first among so many distinct vectors, the first in the order of their hash.
PIVOTS, PREFIX, SAMPLE = 128, 112, 2048
BLOCK, QUERY_BLOCK = 2048, 1024
#: Share of a block's distinct vectors, and least number, that are reranked.
RERANK_SHARE, RERANK_LEAST = 0.3, 100
SCHEMA = "query_id long, query_row long, vec_id long, score double"


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each row, nearest first, ties to the lower number."""
    far = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows that lie apart: the first, then each time the one farthest from those chosen; no equal ones."""
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class InvertedFiles:
    """For each pivot: the place it has in every row's order, m where it is not among a row's first m.

    The prefix is most of the pivots, so a file is a dense array of places by row.
    """

    def __init__(self, perms: np.ndarray, n_pivots: int):
        self.n, self.m = perms.shape
        self.files = np.full((n_pivots, self.n), self.m, np.int16)
        self.files[perms.reshape(-1), np.repeat(np.arange(self.n), self.m)] = np.tile(np.arange(self.m, dtype=np.int16), self.n)
        self.mine = np.arange(self.m, dtype=np.int16)[:, None]

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of the query's prefix to every row, from the files of the query's own pivots."""
        return np.abs(self.files[query] - self.mine).sum(axis=0, dtype=np.int32)


def _classes(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors as one: the distinct rows, and the ids of each, in rising order."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    key = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).reshape(-1)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    size = np.bincount(which)
    return x[first], ids[order], np.cumsum(size) - size, size


def nearest(table: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, prefix: int = PREFIX,
            share: float = RERANK_SHARE, least: int = RERANK_LEAST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` nearest found.

    Score is the Euclidean distance in double precision, nearest first, ties to
    the smaller vec_id, the query itself excluded; all candidates if there are
    fewer than ``k``.  Pivots are drawn from distinct vectors and apart, so a large
    group of copies or near copies takes no more of them than its place in space.  Which vectors take part is told in ``valid_vectors`` (no
    zero vectors); equal vectors of a block are searched as one and all count as
    candidates; rows of the query's own vec_id are excluded, and a repeated vec_id with different
    vectors gives several candidates, and as many queries.  A table without valid vectors gives no rows.
    """
    rows, dim = valid_vectors(table, nonzero=True)
    items = stored(pack(rows, max(dim, 1), lambda x: (x, np.sqrt((x * x).sum(axis=1)))), "permutation")
    n = items.count()
    marked = items.select(F.xxhash64("data").alias("mark"), "data")
    marks = marked.select("mark").distinct().orderBy("mark").limit(SAMPLE).collect()
    drawn = (marked.where(F.col("mark") <= marks[-1][0]).groupBy("mark").agg(F.min("data").alias("data"))
             .orderBy("mark").collect()) if marks else []  # at most ``SAMPLE`` rows
    base = spread_out(np.frombuffer(b"".join(r["data"] for r in drawn), np.float64).reshape(len(drawn), max(dim, 1)), pivots)
    m = min(prefix, max(1, len(base)))
    n_blocks = max(1, -(-n // block))
    queries = items.where(F.col("vec_id") % every == 0)
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spread = items.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int")).withColumn("row", F.xxhash64("vec_id", "data"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x = packed(left["data"], np.float64, dim)
            x, ids, start, size = _classes(left["vec_id"].to_numpy(), x)
            files = InvertedFiles(permutations(x, base, m), len(base))
            q, q_ids, q_rows = packed(right["data"], np.float64, dim), right["vec_id"].to_numpy(), right["row"].to_numpy()
            asks = permutations(q, base, m)
            take = min(len(x), max(least, k + 1, int(np.ceil(share * len(x)))))
            for i in range(len(q)):
                far = files.footrule(asks[i])
                near = np.argpartition(far, take - 1)[:take] if take < len(x) else np.arange(len(x))
                near = np.flatnonzero(far <= far[near].max()) if take < len(x) else near  # ties are all in
                d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                cut = np.partition(d, k)[k] if len(d) > k else np.inf
                near, d = near[d <= cut], d[d <= cut]
                copies = np.minimum(size[near], k + 1)  # no more of one vector can be among the k
                who, d = ids[ragged_index(start[near], copies)], np.repeat(d, copies)
                who, d = who[who != q_ids[i]], d[who != q_ids[i]]
                best = np.lexsort((who, d))[:k]
                out.append((np.full(len(best), q_ids[i]), np.full(len(best), q_rows[i]), who[best], d[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "query_row": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()),
                         "score": pa.array(cols[3], pa.float64())})

    everywhere = [(0, n_blocks, 1.0)]
    asked = asked.withColumn("least", F.lit(0.0))
    return best_of(search_blocks(spread, asked, everywhere, n_query_blocks, search, SCHEMA), k, False)

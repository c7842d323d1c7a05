"""Quality classifier by importance resampling.

Two hashed n-gram models are fitted: one of the target text (documents labelled
good), one of the raw text (all documents).  A document's log importance weight
is the sum over its n-grams of log p_target - log p_raw; documents are sampled
without replacement by Gumbel top-k on these weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import segment_sums, slices, stored, text_bytes
from scorecraft.llm.text_hash import PUNCT_CLASSES, mix, seeded, words

BUCKETS = 1 << 14
#: Most labelled documents that the target model is fitted on (chosen by hash).
MAX_LABELLED = 20_000
SEED = 29
SMOOTHING = 1.0
BINS = 4096


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, and their number per text.

    Words are runs of letters and digits, or of punctuation, A-Z lower-cased.
    A pair of equal words is one and the same n-gram whatever the word, so that
    running repetition is a feature.
    """
    h, counts = words(data, offsets, PUNCT_CLASSES)
    if not h.size:
        return np.zeros(0, np.int64), counts
    last = np.zeros(h.size, bool)
    ends = np.cumsum(counts)
    last[ends[counts > 0] - 1] = True
    pair = np.zeros(h.size, np.uint64)
    pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    pair[:-1][h[:-1] == h[1:]] = np.uint64(1)
    both = np.stack([h, pair], axis=1).reshape(-1)
    keep = np.ones(both.size, bool)
    keep[1::2] = ~last
    return (mix(both[keep]) % np.uint64(buckets)).astype(np.int64), 2 * counts - (counts > 0)


def label_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(_id, _good): at most ``limit`` labelled ids in hash order; an id labelled both ways counts as not good."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good")))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def _with_labels(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    # the sample has at most ``limit`` rows, so it may be broadcast
    return (docs.select("doc_id", "text").join(F.broadcast(label_sample(labels, limit)), F.col("doc_id") == F.col("_id"), "left")
            .select("doc_id", "text", "_good"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, limit: int = MAX_LABELLED) -> np.ndarray:
    """Counts of the raw and the target text per bucket (2 x buckets), over all documents; each task sends one array per model."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            good = batch.column("_good").fill_null(0).to_numpy(zero_copy_only=False) == 1
            for a, b in slices(offsets):
                grams, n = ngram_buckets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], buckets)
                total[0] += np.bincount(grams, minlength=buckets)
                total[1] += np.bincount(grams[np.repeat(good[a:b], n)], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"model": pa.array([0, 1], pa.int32()),
                                          "counts": pa.array(list(total), pa.list_(pa.int64()))})

    sums = (_with_labels(docs, labels, limit).mapInArrow(count, "model int, counts array<long>")
            .select("model", F.posexplode("counts").alias("bucket", "n")).where("n > 0")
            .groupBy("model", "bucket").agg(F.sum("n").alias("n")))
    counts = np.zeros((2, buckets))
    for r in sums.collect():  # at most 2 x buckets rows
        counts[r["model"], r["bucket"]] = r["n"]
    return counts


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket; 0 where there is no target text."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _gumbel(doc_ids: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
    """Keyed Gumbel noise: by the seed and the document id, so a retried task draws the same."""
    h = mix(doc_ids.view(np.uint64) + seeded(seed))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return weights - np.log(-np.log(u))


def _own_share(counts: np.ndarray, grams: np.ndarray, n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """What each text's weight has from its own place in the target counts (0 for texts that are not in them)."""
    out = np.zeros(len(n))
    size = counts.shape[1]
    owner = np.repeat(np.arange(len(n)), n)
    mine = good[owner]
    cell, times = np.unique(owner[mine] * size + grams[mine], return_counts=True)
    have = counts[1][cell % size] + SMOOTHING
    np.add.at(out, cell // size, times * (np.log(have) - np.log(np.maximum(have - times, SMOOTHING))))
    total = counts[1].sum() + SMOOTHING * size
    return out - np.where(good, n * (np.log(total) - np.log(np.maximum(total - n, SMOOTHING))), 0.0)


def _score(batch: pa.RecordBatch, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, weight and key of each row. No document is weighed by a target that it is part of."""
    data, offsets = text_bytes(batch.column("text"))
    good = batch.column("_good").fill_null(0).to_numpy(zero_copy_only=False) == 1
    ratio, known = log_ratio(counts), bool(counts[1].sum())
    ns, ws = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in slices(offsets):
        grams, n = ngram_buckets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], len(ratio))
        ns.append(n)
        w = segment_sums(np.round(ratio[grams] * (1 << 32)).astype(np.int64), n) / (1 << 32)  # exact sums
        ws.append(w - _own_share(counts, grams, n, good[a:b]) if known else w)
    ids = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = np.concatenate(ws)
    return np.concatenate(ns), weight, _gumbel(ids, weight, seed)


def score(docs: DataFrame, labels: DataFrame, counts: np.ndarray, seed: int = SEED, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, quality (NULL where not in the label sample), n_ngrams, log_weight, key (weight plus Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # two doubles per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, key = _score(batch, shared.value, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("_good").cast(pa.int32()), pa.array(n),
                 pa.array(weight), pa.array(key)], names=["doc_id", "quality", "n_ngrams", "log_weight", "key"])

    return _with_labels(docs, labels, limit).mapInArrow(
        run, "doc_id long, quality int, n_ngrams long, log_weight double, key double")


def _bin(col, low: float, high: float):
    """Number of the column's bin, 0 to BINS - 1, between the bounds; rising with the value."""
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((col - low) / max(high - low, 1e-300) * BINS))).cast("int")


def share_of_good(scored: DataFrame) -> int:
    """k: how many documents weigh at least as much as the best cut between the labelled good and bad.

    The cut minimises the sum of both error rates over a histogram of BINS bins
    of asinh(weight); of equal cuts the lowest counts.  Without labels of both
    kinds, k is the number of all documents.
    """
    # asinh keeps every finite weight inside +-40 and is steepest around 0
    hist = (scored.groupBy(_bin(F.asinh("log_weight"), -16.0, 16.0).alias("bin"), "quality")
            .agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3 x BINS rows
    by = np.zeros((3, BINS), np.int64)
    for r in hist:
        by[2, r["bin"]] += r["n"]
        if r["quality"] is not None:
            by[min(max(r["quality"], 0), 1), r["bin"]] += r["n"]
    if not by[0].sum() or not by[1].sum():
        return int(by[2].sum())
    below = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(by, axis=1)], axis=1)
    error = below[1] / by[1].sum() + (1 - below[0] / by[0].sum())
    return int(by[2].sum() - below[2][int(np.argmin(error))])


def top_k_cut(scored: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, found by counting in ever finer bins: no sort, no row leaves its task.

    Rows equal to it are all in.  Infinity if k is 0, -infinity if k covers all rows.
    """
    total, low, high = scored.agg(F.count(key), F.min(key), F.max(key)).first()
    if k <= 0 or not total:
        return math.inf
    if k >= total:
        return -math.inf
    inside = scored.where(F.col(key).isNotNull())
    while True:
        counts = dict(inside.groupBy(_bin(F.col(key), low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                break
            k -= counts[b]
        inside = inside.where(_bin(F.col(key), low, high) == b)
        low, high, n = inside.agg(F.min(key), F.max(key), F.count(key)).first()
        if n <= BINS:
            return sorted((r[0] for r in inside.select(key).collect()), reverse=True)[k - 1]
        if low == high:
            return low


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED,
                      buckets: int = BUCKETS, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_ngrams, log_weight, key, keep: one row per document row, keep for the k largest keys.

    A document of the target sample is weighed without its own counts in the
    target, so that labelled and other documents weigh alike.

    ``k`` defaults to ``share_of_good``.  NULL and empty texts have no n-grams
    and weight 0; a NULL doc_id draws its noise as -1; repeated rows have equal
    keys and are kept or rejected together; without good labels all weights
    are 0 and, as k is then all rows, all are kept; an empty table gives no rows.
    """
    counts = fit(docs, labels, buckets, limit)
    scored = stored(score(docs, labels, counts, seed, limit), "importance")
    k = share_of_good(scored) if k is None else k
    cut = top_k_cut(scored, "key", k)
    return scored.select("doc_id", "n_ngrams", "log_weight", "key", (F.col("key") >= F.lit(cut)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED,
              buckets: int = BUCKETS, limit: int = MAX_LABELLED) -> DataFrame:
    """The documents that ``importance_sample`` keeps, all columns unchanged (scored again by row, no join)."""
    counts = fit(docs, labels, buckets, limit)
    scored = stored(score(docs, labels, counts, seed, limit).select("quality", "log_weight", "key"), "importance")
    cut = top_k_cut(scored, "key", share_of_good(scored) if k is None else k)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names).filter(pa.array(_score(batch, shared.value, seed)[2] >= cut))

    # the label sample has at most ``limit`` rows
    marked = docs.join(F.broadcast(label_sample(labels, limit)), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return marked.mapInArrow(run, docs.schema)

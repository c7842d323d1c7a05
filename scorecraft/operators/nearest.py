"""Nearest class in embedding space (cosine), class softmax, zero-shot classify.

One route at every size.  The class side is cut into blocks of a bounded number of
cells; a block is read by the driver, shipped as a broadcast variable and
multiplied, tile by tile, with Arrow batches of item vectors.  Only the vector
column crosses to Python; the other columns stay where they are, and the item side is neither
shuffled nor keyed.  Per item a running state goes from tile to tile and from
block to block: the best class so far, its similarity, and the sum of the
softmax terms relative to it, which is rescaled when a better class comes.

With one block the whole search is one lazy projection.  With more, the items with
their state are written to the shared checkpoint folder after each block, so that a worker
holds one block at a time.

What holds everywhere: classes with a NULL index take no part; a class vector of
another length than the item's, a zero vector, and one that is NULL or holds a NULL or non-finite component
have no similarity (NULL).  Similarities closer than ``TIE`` count as equal, and the lowest class
index wins.  An item without any similarity gets the lowest class, ``sim`` NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.vectors import as_double
from scorecraft.session import cut_lineage

# Classes x dimension shipped at once (32 MB of doubles), and multiplied at once.
MAX_CLASS_CELLS = 4_000_000
TILE_CELLS = 1 << 18
# Items x classes of one product.
PRODUCT_CELLS = 1 << 21
TIE = 1e-12


def class_centroids(df: DataFrame, label_col: str, vec_col: str,
                    out_vec: str = "class_vec") -> DataFrame:
    """Mean vector per label, element-wise in DOUBLE.

    posexplode -> partial/final average per (label, position): the shuffle
    carries labels x dimension partial sums per task, not the items.
    """
    cells = (df.select(label_col, F.posexplode(as_double(vec_col)).alias("pos", "x"))
               .groupBy(label_col, "pos").agg(F.avg("x").alias("x")))
    return (cells.groupBy(label_col)
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_cells"))
                 .select(label_col, F.transform("_cells", lambda s: s["x"]).alias(out_vec)))


def _kept(classes: DataFrame) -> DataFrame:
    """Keep the class side after its first computation.

    The class vectors are read by the size check and by every scoring pass;
    when they are derived from the items (centroids) this saves re-scanning
    the items for each of those reads.
    """
    if classes.storageLevel.useMemory or classes.storageLevel.useDisk:
        return classes
    return classes.persist(StorageLevel.MEMORY_AND_DISK)


def class_blocks(classes: DataFrame, idx_col: str, vec_col: str,
                 max_cells: int | None = None) -> list[DataFrame]:
    """Split the class side, without NULL indexes, into index ranges of at most ``max_cells`` cells each.

    One small aggregate (count, dimension) decides; if there is more than one
    block, the sorted indexes alone are streamed to find the edges.
    """
    max_cells = max_cells or MAX_CLASS_CELLS
    classes = classes.where(F.col(idx_col).isNotNull())
    st = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    per_block = max(1, max_cells // max(int(st["d"] or 1), 1))
    if st["n"] <= per_block:
        return [classes]
    edges = [r[0] for k, r in enumerate(classes.select(idx_col).orderBy(idx_col).toLocalIterator()) if k % per_block == 0]
    edges = sorted(set(edges))
    return [classes.where((F.col(idx_col) >= a) & ((F.col(idx_col) < b) if b is not None else F.lit(True)))
            for a, b in zip(edges, [*edges[1:], None], strict=True)]


# ---- inside the tasks --------------------------------------------------------------------

def unit_rows(col: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which vectors have a direction; and, per length, their places and unit vectors."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(pc.fill_null(col.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
    start = np.cumsum(size) - size
    ok, by_length = np.zeros(n, bool), {}
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        x = flat.reshape(n, d) if len(at) == n else flat[start[at][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        ok[at[good]] = True
        by_length[int(d)] = at[good], x[good] / norm[good][:, None]
    return ok, by_length


class ClassBlock:
    """A block of classes in index order, with unit vectors in tiles per length."""

    def __init__(self, idx: list, labels: list, vecs: list):
        self.idx, self.labels = idx, labels
        _, by_length = unit_rows(pa.array(vecs, pa.list_(pa.float64())))
        self.tiles: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for d, (at, unit) in by_length.items():
            step = max(1, TILE_CELLS // d)
            self.tiles[d] = [(at[k:k + step], unit[k:k + step]) for k in range(0, len(at), step)]

    def products(self, by_length: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item places, class places, similarities) for slices of the items against every tile, classes in order."""
        for d, (at, x) in by_length.items():
            for who, unit in self.tiles.get(d, []):
                step = max(1, PRODUCT_CELLS // len(who))
                for k in range(0, len(at), step):
                    yield at[k:k + step], who, x[k:k + step] @ unit.T


class State:
    """Best class, its similarity and the softmax sum relative to it, per item of a batch."""

    def __init__(self, n: int, scale: float, before: pa.Array | None = None):
        self.scale, self.kept = scale, before
        self.best = np.full(n, -1)  # place in this block; -1: none better than before
        self.sim, self.z = (np.full(n, np.nan), np.zeros(n)) if before is None else (
            before.field(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in ("sim", "z"))

    def add(self, at: np.ndarray, who: np.ndarray, sims: np.ndarray) -> None:
        top = sims.max(axis=1)
        first = (sims >= top[:, None] - TIE).argmax(axis=1)
        old = self.sim[at]
        new = np.isnan(old) | (top > old + TIE)
        # the sum is kept relative to the winner's similarity
        base = np.where(new, sims[np.arange(len(at)), first], old)
        with np.errstate(invalid="ignore"):
            rescaled = np.where(np.isnan(old), 0.0, self.z[at] * np.exp(self.scale * (np.nan_to_num(old) - base)))
        self.z[at] = rescaled + np.exp(self.scale * (sims - base[:, None])).sum(axis=1)
        self.sim[at] = base
        self.best[at[new]] = who[first[new]]

    def result(self, block: ClassBlock, idx_type: pa.DataType, ok: np.ndarray) -> pa.Array:
        fresh = self.best >= 0
        place = pa.array(np.where(fresh, self.best, 0), pa.int64())
        some = len(block.idx) > 0
        idx = pa.array(block.idx, idx_type).take(place) if some else pa.nulls(len(fresh), idx_type)
        label = pa.array(block.labels, pa.string()).take(place) if some else pa.nulls(len(fresh), pa.string())
        if self.kept is not None:
            idx = pc.if_else(pa.array(fresh), idx, self.kept.field("class_idx").cast(idx_type))
            label = pc.if_else(pa.array(fresh), label, self.kept.field("class_label").cast(pa.string()))
        none = pa.array(np.isnan(self.sim))
        return pa.StructArray.from_arrays(
            [idx, label, pa.array(self.sim, mask=np.isnan(self.sim)), pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(self.z)), pa.array(ok)],
            names=["class_idx", "class_label", "sim", "z", "has_vector"])


# ---- one pass per block ------------------------------------------------------------------

def _shipped(block: DataFrame, class_idx: str, class_label: str, class_vec: str):
    """Broadcast variable of one block (bounded by ``class_blocks``)."""
    rows = block.select(F.col(class_idx).alias("i"), F.col(class_label).cast("string").alias("l"), as_double(class_vec).alias("v")).collect()
    rows = sorted(rows, key=lambda r: (r["i"], r["l"] or ""))
    return block.sparkSession.sparkContext.broadcast(ClassBlock([r["i"] for r in rows], [r["l"] for r in rows], [r["v"] for r in rows]))


def _scan(vec: Column, state: Column | None, shipped, idx_type: str, scale: float) -> Column:
    """The running state after one block, a struct column."""
    arrow_type = pa.int32() if idx_type == "int" else pa.int64() if idx_type == "bigint" else pa.string()
    schema = f"struct<class_idx:{idx_type},class_label:string,sim:double,z:double,has_vector:boolean>"

    def run(col: pa.Array, before: pa.Array | None) -> pa.Array:
        block = shipped.value
        ok, vectors = unit_rows(col)
        held = State(len(col), scale, before)
        for at, who, sims in block.products(vectors):
            held.add(at, who, sims)
        return held.result(block, arrow_type, ok)

    if state is None:
        def first(v: pa.Array) -> pa.Array:
            return run(v, None)
        return F.arrow_udf(first, schema)(vec)

    def further(v: pa.Array, before: pa.Array) -> pa.Array:
        return run(v, before)
    return F.arrow_udf(further, schema)(vec, state)


def _best_class(items: DataFrame, vec_col: str, blocks: list[DataFrame], names: tuple[str, str, str], scale: float) -> DataFrame:
    """``items`` with the struct ``_best``."""
    idx_type = blocks[0].schema[names[0]].dataType.simpleString()
    idx_type = idx_type if idx_type in ("int", "bigint", "string") else "bigint"
    out = items
    for k, block in enumerate(blocks):
        shipped = _shipped(block.withColumn(names[0], F.col(names[0]).cast(idx_type)), *names)
        out = out.withColumn("_best", _scan(F.col(vec_col), F.col("_best") if k else None, shipped, idx_type, scale))
        if len(blocks) > 1:
            out = cut_lineage(out)
            shipped.unpersist()
    return out


def nearest_class(items: DataFrame, vec_col: str, classes: DataFrame,
                  class_idx: str = "class_idx", class_label: str = "class_label",
                  class_vec: str = "class_vec", logit_scale: float | None = None) -> DataFrame:
    """Adds ``predicted_idx``, ``predicted_label``, ``sim`` (cosine of the winner) and ``zero_norm``.

    ``zero_norm`` is true for an item vector without a direction (zero, NULL, or with a
    NULL or non-finite component).  With ``logit_scale`` the winner's softmax
    probability is added as ``prob``.  An empty class side gives NULL predictions.
    """
    classes = _kept(classes)
    blocks = class_blocks(classes, class_idx, class_vec)
    out = _best_class(items, vec_col, blocks, (class_idx, class_label, class_vec), logit_scale or 1.0)
    best = F.col("_best")
    out = (out.withColumn("predicted_idx", best["class_idx"]).withColumn("predicted_label", best["class_label"])
              .withColumn("sim", best["sim"]).withColumn("zero_norm", ~best["has_vector"]))
    if logit_scale is not None:
        out = out.withColumn("prob", 1 / best["z"])
    return out.drop("_best")


def zero_shot(items: DataFrame, vec_col: str, gt_col: str, classes: DataFrame,
              logit_scale: float = 100.0, class_idx: str = "class_idx",
              class_label: str = "class_label", class_vec: str = "class_vec") -> DataFrame:
    """Classify each item: winner by cosine, its softmax probability, correct flag."""
    out = nearest_class(items, vec_col, classes, class_idx, class_label, class_vec, logit_scale)
    correct = F.col("sim").isNotNull() & (F.col(gt_col).cast("string") == F.col("predicted_label"))
    return out.drop("zero_norm").withColumn("correct", F.coalesce(correct, F.lit(False)))


# ---- one row per item and class ----------------------------------------------------------

def _each_class(vec: Column, state: Column | None, shipped, scale: float) -> Column:
    """Array of (place in the block, sim, prob) of every class of a block; ``prob`` is relative to ``state``."""
    def run(col: pa.Array, before: pa.Array | None) -> pa.Array:
        block = shipped.value
        n, c = len(col), len(block.idx)
        sims = np.full((n, c), np.nan)
        for at, who, part in block.products(unit_rows(col)[1]):
            sims[at[:, None], who[None, :]] = part
        if before is None:
            prob = np.full((n, c), np.nan)
        else:
            top = before.field("sim").to_numpy(zero_copy_only=False).astype(np.float64)
            z = before.field("z").to_numpy(zero_copy_only=False).astype(np.float64)
            prob = np.exp(scale * (sims - top[:, None])) / z[:, None]
        flat = pa.StructArray.from_arrays(
            [pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(sims.ravel(), mask=np.isnan(sims.ravel())),
             pa.array(prob.ravel(), mask=np.isnan(prob.ravel()))], names=["place", "sim", "prob"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c), flat)

    schema = "array<struct<place:int,sim:double,prob:double>>"
    if state is None:
        def alone(v: pa.Array) -> pa.Array:
            return run(v, None)
        return F.arrow_udf(alone, schema)(vec)

    def relative(v: pa.Array, before: pa.Array) -> pa.Array:
        return run(v, before)
    return F.arrow_udf(relative, schema)(vec, state)


def _long(items: DataFrame, vec_col: str, blocks: list[DataFrame], names: tuple[str, str, str], keep: list[str],
          state: str | None, scale: float) -> DataFrame:
    parts = []
    for block in blocks:
        shipped = _shipped(block, *names)
        listed = F.array(*[F.struct(F.lit(i).alias("class_idx"), F.lit(label).alias("class_label"))
                           for i, label in zip(shipped.value.idx, shipped.value.labels, strict=True)])
        if not shipped.value.idx:
            listed = F.lit(None).cast("array<struct<class_idx:int,class_label:string>>")
        each = items.select(*keep, F.explode(_each_class(F.col(vec_col), F.col(state) if state else None, shipped, scale)).alias("_s"))
        parts.append(each.withColumn("_c", F.element_at(listed, F.col("_s.place") + 1))
                     .select(*keep, "_c.class_idx", "_c.class_label", "_s.sim", "_s.prob"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# Classes x dimension of one block where every class gives a row: at most some hundreds of classes meet a batch of items.
LONG_CELLS = 32_768


def cosine_matrix(items: DataFrame, vec_col: str, classes: DataFrame,
                  class_idx: str = "class_idx", class_label: str = "class_label",
                  class_vec: str = "class_vec", keep: list[str] | None = None) -> DataFrame:
    """Long similarity matrix: one row per (item, class), ``sim`` NULL where there is none."""
    classes = _kept(classes)
    keep = keep or [c for c in items.columns if c != vec_col]
    blocks = class_blocks(classes, class_idx, class_vec, min(MAX_CLASS_CELLS, LONG_CELLS))
    return _long(items, vec_col, blocks, (class_idx, class_label, class_vec), keep, None, 1.0).drop("prob")


def class_softmax(items: DataFrame, vec_col: str, classes: DataFrame, logit_scale: float = 100.0,
                  class_idx: str = "class_idx", class_label: str = "class_label",
                  class_vec: str = "class_vec", keep: list[str] | None = None) -> DataFrame:
    """Softmax over scaled cosine logits, one row per item and class.

    The winner and the sum come from the running state of ``nearest_class``; a second step
    gives every class its share.  Classes without a similarity are in neither: ``prob`` NULL.
    """
    classes = _kept(classes)
    keep = keep or [c for c in items.columns if c != vec_col]
    names = (class_idx, class_label, class_vec)
    stats = _best_class(items, vec_col, class_blocks(classes, class_idx, class_vec), names, logit_scale)
    blocks = class_blocks(classes, class_idx, class_vec, min(MAX_CLASS_CELLS, LONG_CELLS))
    return _long(stats, vec_col, blocks, names, keep, "_best", logit_scale)

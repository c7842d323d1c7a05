"""Hard negatives per anchor and positive, found with spanning-tree bounds between anchors.

Anchors are put into blocks of near ones, and each block gets a minimum spanning
tree.  If a candidate of length |x| scores s with an anchor, it scores with a
child of that anchor at edge distance d between s - d|x| and s + d|x|, so along
the tree every score is known within bounds; only candidates whose bounds
overlap the child's window are scored exactly, which makes their bounds tight
again for the next edge.

Two searches run this way.  The positives of an anchor are its best rows of the
same label: the window starts at the worst of the parent's own finds, scored
with the child.  The negatives are rows of other labels whose score lies in the
window of a positive.  Candidates go only to those cells of anchors whose hull of
windows their bounds from the cell's centre overlap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.common import stored
from scorecraft.session import bounded_broadcast

ANCHOR_BLOCK, ITEM_BLOCK = 1024, 2048
# Cells of anchors for routing; their centres are so many anchors at most.
MAX_CELLS = 256
# From this share of overlapping candidates on, one matrix product is cheaper than single ones.
DENSE = 0.1
# Bounds are loosened by this for rounding; scores are exact.
EPS = 1e-9
# Whole numbers up to this are exact in double precision.
EXACT = 2.0 ** 53


# ---- vectors of whole numbers ------------------------------------------------------------

def valid_rows(table: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: no NULL id, label or vector, all components finite."""
    x = F.col("vec")
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
          & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<double>").alias("vec")).where(ok)


class Kind:
    """How components are kept and multiplied: the narrowest type that holds the largest one."""

    def __init__(self, top: float, dim: int):
        self.dtype = np.dtype(np.int16 if top < 2 ** 15 else np.int32 if top < 2 ** 31 else np.float64)
        self.exact = max(1, dim) * top * top < EXACT

    def unpack(self, column: pa.ChunkedArray, dim: int) -> np.ndarray:
        """Rows as doubles; a vector shorter than ``dim`` is filled up with zeros."""
        raw = column.to_pylist()
        width = dim * self.dtype.itemsize
        if any(len(r) != width for r in raw):
            raw = [r.ljust(width, b"\0") for r in raw]
        return np.frombuffer(b"".join(raw), self.dtype).reshape(len(raw), dim).astype(np.float64)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of all rows of a and b as whole numbers; an error beyond 64 bits."""
        if self.exact:
            return (a @ b.T).astype(np.int64)
        return self._long(_whole(a) @ _whole(b).T)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of row i of a and row i of b."""
        if self.exact:
            return np.einsum("ij,ij->i", a, b).astype(np.int64)
        return self._long((_whole(a) * _whole(b)).sum(axis=1))

    @staticmethod
    def _long(x: np.ndarray) -> np.ndarray:
        if x.size and (abs(x) >= 2 ** 63).any():
            raise OverflowError("an inner product is beyond 64 bits")
        return x.astype(np.int64)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def packed_rows(rows: DataFrame, scale: int) -> tuple[DataFrame, Kind, int]:
    """(row, vec_id, label, norm, data) with whole components floor(scale x), how they are kept, and the largest dimension."""
    whole = rows.select("vec_id", "label", F.transform("vec", lambda v: v * scale).alias("vec"))
    known = whole.agg(F.max(F.array_max(F.transform("vec", F.abs))).alias("top"), F.max(F.size("vec")).alias("dim")).first()
    kind, dim = Kind((known["top"] or 0.0) + 1, known["dim"] or 0), known["dim"] or 0

    def run(batches):
        for batch in batches:
            flat = np.floor(batch.column("vec").flatten().to_numpy(zero_copy_only=False))
            if not np.isfinite(flat).all():
                raise OverflowError("a scaled component is beyond double precision")
            ends = np.cumsum(batch.column("vec").value_lengths().to_numpy(zero_copy_only=False))
            bits = np.split(flat, ends[:-1]) if batch.num_rows else []
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"),
                "norm": pa.array([float(np.sqrt((b * b).sum())) for b in bits], pa.float64()),
                "data": pa.array([b.astype(kind.dtype).tobytes() for b in bits], pa.binary())})

    kept = whole.mapInArrow(run, "vec_id long, label long, norm double, data binary")
    return stored(kept.withColumn("row", F.monotonically_increasing_id()), "negatives-rows"), kind, dim


# ---- trees -------------------------------------------------------------------------------

def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root, the row nearest the mean) and edge length of each row in a minimum spanning tree."""
    n = len(x)
    square = (x * x).sum(axis=1)
    best, parent = np.full(n, np.inf), np.full(n, -1)
    open_ = np.ones(n, bool)
    at = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    for _ in range(n - 1):
        open_[at] = False
        gap = square + square[at] - 2 * (x @ x[at])
        closer = open_ & (gap < best)
        best[closer], parent[closer] = gap[closer], at
        at = int(np.argmin(np.where(open_, best, np.inf)))
    edge = np.sqrt(((x - x[np.maximum(parent, 0)]) ** 2).sum(axis=1))
    edge[parent < 0] = 0
    return parent, edge


def with_trees(anchors: DataFrame, keys: list[str], kind: Kind, dim: int) -> DataFrame:
    """``anchors`` with (pos, parent, edge) of the tree of each block (one group of ``keys``, bounded by the caller)."""
    def grow(block: pa.Table) -> pa.Table:
        parent, edge = spanning_tree(kind.unpack(block["data"], dim))
        for name, col in (("pos", np.arange(len(parent))), ("parent", parent), ("edge", edge)):
            block = block.append_column(name, pa.array(col, pa.float64() if name == "edge" else pa.int32()))
        return block

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return stored(anchors.groupBy(*keys).applyInArrow(grow, f"{fields}, pos int, parent int, edge double"), "negatives-trees")


def scan_tree(parent: np.ndarray, edge: np.ndarray, x: np.ndarray, y: np.ndarray, norm: np.ndarray, kind: Kind,
              window: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
              found: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Scores of the candidates ``y`` with the anchors ``x``, from the root down; returns how many were scored exactly.

    ``window(nodes, parents)`` gives the least and highest score of interest of
    each node; ``found(node, candidates, scores)`` is told the candidates whose bounds
    overlap it, with exact scores.
    """
    exact = 0
    nodes = np.flatnonzero(parent < 0)
    low = high = np.zeros((0, len(y)))
    place = np.full(len(x), -1)
    while len(nodes):
        least, most = window(nodes, parent[nodes])
        if parent[nodes[0]] < 0:
            low, high = np.full((len(nodes), len(y)), -np.inf), np.full((len(nodes), len(y)), np.inf)
            overlap = np.ones((len(nodes), len(y)), bool)  # nothing is known at the root
        else:
            up = place[parent[nodes]]
            reach = edge[nodes][:, None] * norm[None, :]
            low, high = low[up] - reach, high[up] + reach
            slack = EPS * (1 + np.maximum(np.abs(low), np.abs(high)))
            low, high = low - slack, high + slack
            overlap = (high >= least[:, None]) & (low <= most[:, None])
        for at in range(0, len(nodes), 256):  # a level in slices, for the memory
            part = slice(at, at + 256)
            r, c = np.nonzero(overlap[part])
            exact += len(r)
            if len(r) > DENSE * overlap[part].size:
                score = kind.products(x[nodes[part]], y)[r, c]
            else:
                score = kind.pairs(x[nodes[part]][r], y[c])
            low[part][r, c] = high[part][r, c] = score
            ends = np.searchsorted(r, np.arange(len(nodes[part]) + 1))
            for i, node in enumerate(nodes[part]):
                found(int(node), c[ends[i]:ends[i + 1]], score[ends[i]:ends[i + 1]])
        place[nodes] = np.arange(len(nodes))
        nodes = np.flatnonzero(np.isin(parent, nodes))
    return exact


def first_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


# ---- positives ---------------------------------------------------------------------------

def find_positives(rows: DataFrame, anchors: DataFrame, k: int, kind: Kind, dim: int, anchor_block: int, item_block: int) -> DataFrame:
    """(row, no, positive_id, positive_score): each anchor's ``k`` best rows of its label with another vec_id."""
    asked = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("_a"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_i")).join(asked, "label")
    sizes = stored(sizes.select("label", F.ceil(F.col("_a") / anchor_block).alias("a_parts"), F.ceil(F.col("_i") / item_block).alias("i_parts")),
                   "negatives-labels")
    sizes, _ = bounded_broadcast(sizes)
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    blocks = with_trees(anchors.join(sizes, "label").withColumn("part", part("a_parts")).drop("a_parts", "i_parts"), ["label", "part"], kind, dim)
    # one copy of an anchor per block of candidates, and of a candidate per block of anchors of its label
    left = (blocks.join(sizes.select("label", "i_parts"), "label")
            .withColumn("i_part", F.explode(F.sequence(F.lit(0), (F.col("i_parts") - 1).cast("int")))).drop("i_parts"))
    right = (rows.join(sizes, "label").withColumn("i_part", part("i_parts"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("a_parts") - 1).cast("int")))).drop("a_parts", "i_parts"))
    keys = ["label", "part", "i_part"]

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            a = a.sort_by("pos")
            x, y = kind.unpack(a["data"], dim), kind.unpack(b["data"], dim)
            own, a_row = a["vec_id"].to_numpy(), a["row"].to_numpy()
            ids, norm = b["vec_id"].to_numpy(), b["norm"].to_numpy()
            best: dict[int, np.ndarray] = {}

            def window(nodes: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                least = np.full(len(nodes), -np.inf)
                for i, (node, up) in enumerate(zip(nodes, parents, strict=True)):
                    seen = best.get(int(up), np.zeros(0, np.int64))
                    seen = seen[ids[seen] != own[node]]
                    if len(seen) >= k:
                        least[i] = np.sort(kind.products(x[node][None], y[seen])[0])[-k]
                return least, np.full(len(nodes), np.inf)

            def found(node: int, who: np.ndarray, score: np.ndarray) -> None:
                top = first_k(ids[who], score, k + 1)  # one more for the children: a child may be among them
                best[node] = who[top]
                other = ids[who] != own[node]
                who, score = who[other], score[other]
                top = first_k(ids[who], score, k)
                out.append((np.full(len(top), a_row[node]), ids[who[top]], score[top]))

            scan_tree(a["parent"].to_numpy(), a["edge"].to_numpy(), x, y, norm, kind, window, found)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "positive_id", "positive_score"), cols, strict=True)})

    finds = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "row long, positive_id long, positive_score long")
    w = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    return finds.withColumn("no", F.row_number().over(w)).where(F.col("no") <= k)


# ---- negatives ---------------------------------------------------------------------------

def _cells(anchors: DataFrame, kind: Kind, dim: int, anchor_block: int) -> tuple[DataFrame, np.ndarray]:
    """``anchors`` with the cell of the nearest centre and the distance to it; the centres (at most MAX_CELLS anchors)."""
    n = max(1, min(MAX_CELLS, -(-anchors.count() // anchor_block)))
    some = anchors.select("data", F.xxhash64("row").alias("h")).orderBy("h").limit(n).select("data").toArrow()
    centres = kind.unpack(some["data"], dim) if some.num_rows else np.zeros((1, dim))
    shared = anchors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            x, c = kind.unpack(batch.column("data"), dim), shared.value
            gap = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
            cell = gap.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())],
                                             names=[*batch.schema.names, "cell", "far"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(assign, f"{fields}, cell int, far double"), centres


def find_negatives(rows: DataFrame, anchors: DataFrame, k: int, low: int, high: int, kind: Kind, dim: int,
                   anchor_block: int, item_block: int) -> DataFrame:
    """``anchors`` has an array ``wanted`` of (no, positive_id, positive_score); one row per find, the ``k`` best per positive."""
    celled, centres = _cells(anchors, kind, dim, anchor_block)
    celled = stored(celled, "negatives-cells")
    hull = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("far"),
        F.min(F.array_min(F.transform("wanted", lambda p: p["positive_score"]))).alias("least"),
        F.max(F.array_max(F.transform("wanted", lambda p: p["positive_score"]))).alias("most")).collect()  # at most MAX_CELLS rows
    hull = sorted(hull, key=lambda h: h["cell"])
    parts = {h["cell"]: -(-h["n"] // anchor_block) for h in hull}
    n_parts = F.element_at(F.create_map(*[F.lit(int(v)) for c, p in parts.items() for v in (c, p)]), F.col("cell")) if parts else F.lit(1)
    blocks = with_trees(celled.withColumn("part", F.pmod(F.xxhash64("row"), n_parts.cast("long")).cast("int")).drop("far"), ["cell", "part"], kind, dim)

    n_blocks = max(1, -(-rows.count() // item_block))
    own = np.array([h["cell"] for h in hull], np.int64)
    far = np.array([h["far"] for h in hull])
    # windows of positives below zero hold nothing
    least = np.array([min(h["least"], h["least"] * low / high) for h in hull], float)
    most = np.array([h["most"] for h in hull], float)
    shared = rows.sparkSession.sparkContext.broadcast((centres[own] if len(own) else np.zeros((0, dim)), own, far, least, most))

    def route(batches):
        c, cells, far, least, most = shared.value
        for batch in batches:
            y, norm = kind.unpack(batch.column("data"), dim), batch.column("norm").to_numpy()
            score, reach = y @ c.T, norm[:, None] * far[None, :]
            slack = EPS * (1 + np.abs(score) + reach)
            r, i = np.nonzero((score + reach + slack >= least) & (score - reach - slack <= most))
            yield pa.RecordBatch.from_arrays([*[col.take(pa.array(r)) for col in batch.columns], pa.array(cells[i], pa.int32())],
                                             names=[*batch.schema.names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    right = (rows.mapInArrow(route, f"{fields}, cell int").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), (n_parts - 1).cast("int")))))
    left = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    keys = ["cell", "part", "block"]
    names = ("row", "no", "negative_id", "negative_score")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            a = a.sort_by("pos")
            x, y = kind.unpack(a["data"], dim), kind.unpack(b["data"], dim)
            a_row, a_label, wanted = a["row"].to_numpy(), a["label"].to_numpy(), a["wanted"].to_pylist()
            ids, label, norm = b["vec_id"].to_numpy(), b["label"].to_numpy(), b["norm"].to_numpy()
            tops = np.array([max(p["positive_score"] for p in w) for w in wanted], float)
            lows = np.array([min(p["positive_score"] for p in w) for w in wanted], float) * low / high

            def found(node: int, who: np.ndarray, score: np.ndarray) -> None:
                fits = (label[who] != a_label[node]) & (score >= lows[node] - 1) & (score <= tops[node])
                who, score = who[fits], score[fits]
                for p in wanted[node]:
                    at_most = int(p["positive_score"])
                    # -(-a // b) rounds up: the least whole score with high * score >= low * positive
                    some = np.flatnonzero((score <= at_most) & (score >= -(-low * at_most // high)))
                    top = some[first_k(ids[who[some]], score[some], k)]
                    out.append((np.full(len(top), a_row[node]), np.full(len(top), p["no"]), ids[who[top]], score[top]))

            scan_tree(a["parent"].to_numpy(), a["edge"].to_numpy(), x, y, norm, kind,
                      lambda nodes, _: (lows[nodes] - 1, tops[nodes]), found)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    finds = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, ", ".join(f"{n} long" for n in names))
    w = Window.partitionBy("row", "no").orderBy(F.desc("negative_score"), "negative_id")
    return finds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, anchor_block: int = ANCHOR_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``table`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id.  Components become
    floor(scale x); a score is the exact inner product.  An anchor's positives are the best
    ``positives`` rows of its label; for each come the best ``negatives`` rows of other labels with
    low * positive_score <= high * score <= high * positive_score.  Ties go to the smaller vec_id.

    Rows without id, label or vector, or with a NULL or non-finite component, take no part.  Vectors of unlike lengths are
    compared as if the shorter went on with zeros (an empty one scores 0).  Each row of a repeated vec_id counts, as an anchor too, but rows with
    the anchor's own vec_id are never its positives.  A positive with a score below zero has an empty window.
    An empty table, or one without anchors, gives no rows; an anchor without other rows of its label none.  A product
    beyond 64 bits is an error.  Other columns are not read.
    """
    rows, kind, dim = packed_rows(valid_rows(table), scale)
    anchors = rows.where(is_anchor)
    found = find_positives(rows, anchors, positives, kind, dim, anchor_block, item_block)
    found = stored(found, "negatives-positives")
    wanted = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "positive_id", "positive_score"))).alias("wanted"))  # at most ``positives``
    asked = stored(anchors.join(wanted, "row"), "negatives-asked")
    mined = find_negatives(rows, asked, negatives, low, high, kind, dim, anchor_block, item_block)
    names = asked.select("row", F.col("vec_id").alias("anchor_id"), F.explode("wanted").alias("p"))
    return (mined.join(names.select("row", "anchor_id", "p.*"), ["row", "no"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def shifted_labels(embeddings: DataFrame, every: int = 7, n_labels: int = 10) -> DataFrame:
    """``embeddings`` with label (label + 1) % ``n_labels`` where ``every`` divides vec_id."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), "embedding")

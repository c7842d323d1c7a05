"""N-gram Jaccard self-join of texts with several global token orders.

A text's set are the hashes of its distinct 5-word shingles; two texts link when
their sets' Jaccard similarity is 0.8 or more (100 |A n B| >= 80 |A u B|).

* Texts with equal sets are one class from the start, with a node number of its own; a class is
  represented by its row of smallest doc_id (known ids first), then smallest text hash.
* Under a global order of all shingles, linked sets share a shingle in their
  prefixes, at places that still leave room for the overlap.  The order is by
  estimated frequency, rare ones first, then by hash.  Shingles of the first
  order's prefixes are the keys that classes meet under.
* Classes that meet are not all paired: first each meets a few leaders (stars),
  which is linear in the bucket and joins groups of near copies; only then all
  pairs from different components are made.  No link between different
  components is lost, so components are exact.
* Prefixes are long enough for all sizes a partner may have, so two sets of like
  size must share not one but ``needed`` prefix shingles.  A pair is a candidate
  only if it shares that many in the first order, and that many again in each of the
  other orders (other hashes and other frequency estimates), before its sets
  are intersected.

Sets are compared by 64-bit shingle hashes and classes by 128-bit set hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.common import slices, stored, text_bytes
from scorecraft.llm.components import components
from scorecraft.llm.text_hash import SPACE_CLASSES, mix, seeded, words
from scorecraft.session import bounded_broadcast

WORDS = 5
NUM, DEN = 80, 100
#: The global orders: a hash seed each. The first gives the keys, the others filter.
ORDERS = (101, 202, 303)
# Frequencies are estimated in a table of this many counters per order.
COUNTERS = 1 << 16
CHUNKS = 64
# Rounds of stars, and the leaders of a key in each.
STARS = (2, 6)
# Leaders are drawn by their share of own prefix shingles plus a random part of up to this much.
LEADER_SPREAD = 0.1
# A key of more classes is worked on in blocks of about so many classes.
FREQUENT, BLOCK = 64, 1024
# Keys of a unit that are counted in one product.
KEYS_AT_ONCE = 2048
# Rows that name the texts to verify are broadcast up to this many (some 40 bytes each), and joined by a shuffle beyond.
MAX_BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and their number."""
    h, counts = words(data, offsets, SPACE_CLASSES)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not h.size:
        return np.zeros(0, np.uint64), n
    start = np.cumsum(counts) - counts
    at = np.repeat(start, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    room = np.repeat(np.minimum(counts, k), n)
    out = room.astype(np.uint64)
    for i in range(k):
        inside = room > i
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + i])
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(out.size, bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.bincount(doc[keep], minlength=len(n)).astype(np.int64)


def texts_in(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, numbers) of a batch, a bounded amount of text at a time."""
    data, offsets = text_bytes(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, *shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def counter_of(shingles: np.ndarray, order: int) -> np.ndarray:
    return (mix(shingles ^ seeded(ORDERS[order], 7)) % np.uint64(COUNTERS)).astype(np.int64)


def order_key(shingles: np.ndarray, order: int, levels: np.ndarray) -> np.ndarray:
    """Place of each shingle in a global order: 8 bits of estimated frequency, then 56 of its hash."""
    return (levels[order][counter_of(shingles, order)].astype(np.uint64) << np.uint64(56)) | (
        mix(shingles + seeded(ORDERS[order])) >> np.uint64(8))


def prefix_length(n):
    """Two sets of n and at most n / 0.8 shingles that link share one of the first so many of n."""
    return n - -(-n * NUM // DEN) + 1


def _prefix_length():
    return F.col("n") - F.ceil(F.col("n") * F.lit(NUM) / F.lit(DEN)) + 1


def frequency_levels(sketch: np.ndarray) -> np.ndarray:
    """0 for counters that look like chance, and one more for each doubling above (orders x COUNTERS, uint8)."""
    mean = sketch.mean(axis=1, keepdims=True)
    over = (sketch - mean) / (4 * np.sqrt(np.maximum(mean, 1.0)))
    return np.where(over < 1, 0, 1 + np.floor(np.log2(np.maximum(over, 1)))).astype(np.uint8)


def _signatures(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, h, n, s1, s2), and per task and chunk of the counters one row with its sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((len(ORDERS), COUNTERS), np.int64)
        for batch in batches:
            sums = [[np.zeros(0, np.uint64)] for _ in range(2)]
            sizes = [np.zeros(0, np.int64)]
            for _, _, shingles, n in texts_in(batch):
                for o in range(len(ORDERS)):
                    sketch[o] += np.bincount(counter_of(shingles, o), minlength=COUNTERS)
                ends = np.cumsum(n)
                for k in (0, 1):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles + seeded(k, 55)), dtype=np.uint64)])
                    sums[k].append(total[ends] - total[ends - n])
                sizes.append(n)
            size = np.concatenate(sizes)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": pa.array(size),
                "s1": pa.array(np.concatenate(sums[0]).view(np.int64)), "s2": pa.array(np.concatenate(sums[1]).view(np.int64)),
                "chunk": pa.nulls(len(size), pa.int32()), "sums": pa.nulls(len(size), pa.binary())})
        parts = sketch.reshape(CHUNKS, -1)
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": none, "h": none, "n": none, "s1": none, "s2": none, "chunk": pa.array(range(CHUNKS), pa.int32()),
            "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, h long, n long, s1 long, s2 long, chunk int, sums binary")


def _sketch(signed: DataFrame) -> np.ndarray:
    """Sum of all tasks' counters: in two steps, so that no group holds a row of every task."""
    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group["sums"].to_pylist())
        return pa.table({"chunk": group["chunk"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = signed.where("chunk IS NOT NULL").select("chunk", "sums", F.pmod(F.xxhash64("sums"), F.lit(32)).alias("part"))
    some = parts.groupBy("chunk", "part").applyInArrow(add, "chunk int, sums binary")
    rows = some.groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect()  # CHUNKS rows, fixed size
    flat = b"".join(r["sums"] for r in sorted(rows, key=lambda r: r["chunk"]))
    return np.frombuffer(flat, np.int64).reshape(len(ORDERS), COUNTERS) if flat else np.zeros((len(ORDERS), COUNTERS), np.int64)


def _prefixes(docs: DataFrame, levels) -> DataFrame:
    """doc_id, h, n, keys: the prefix of each set under the first order, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, n in texts_in(batch):
                doc = np.repeat(np.arange(b - a), n)
                rank = order_key(shingles, 0, levels.value)
                order = np.lexsort((rank, doc))
                first = np.cumsum(n) - n
                place = np.arange(len(order)) - np.repeat(first, n)
                take = place < np.repeat(np.where(n > 0, prefix_length(n), 0), n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[take], minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "h": batch.column("h").slice(a, b - a), "n": pa.array(n), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(shingles[order][take].view(np.int64)))})

    return docs.mapInArrow(run, "doc_id long, h long, n long, keys array<long>")


def _same_row(a: str, b: str):
    """Rows of one doc_id, NULL or not, and one text."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def _postings(docs: DataFrame, classes: DataFrame, levels) -> DataFrame:
    """(key, node, n, place, k) for keys that more than one class has in its prefix; k counts these keys of the class."""
    keyed = _prefixes(docs, levels).where("n > 0").alias("k").join(classes.select("node", "doc_id", "h").alias("c"), _same_row("k", "c"))
    # repeated rows of a class's doc_id and text are one
    keyed = keyed.select("node", F.col("k.n").cast("int").alias("n"), "keys").dropDuplicates(["node"])
    rows = stored(keyed.select("node", "n", F.posexplode("keys").alias("place", "key")), "prefixes")
    # counted before the shuffle, and joined so that Spark may split a frequent key
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_met")).where("_met > 1").select("key")
    met = rows.join(shared, "key")
    return stored(met.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("node"))), "postings")


def _texts(docs: DataFrame, rows: DataFrame, classes: DataFrame, postings: DataFrame) -> DataFrame:
    """(node, text) of the classes that meet any other, one row each."""
    met = classes.join(postings.select("node").distinct(), "node").select("node", "doc_id", "h")
    # few rows are repeated; only their texts need to be made one
    twice = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", "h", F.lit(True).alias("many"))
    met = met.alias("m").join(twice.alias("t"), _same_row("m", "t"), "left").select("node", "m.doc_id", "m.h", F.coalesce("many", F.lit(False)).alias("many"))
    met, _ = bounded_broadcast(stored(met, "met"), MAX_BROADCAST_IDS)
    found = docs.alias("d").join(met.alias("m"), _same_row("d", "m")).select("node", "text", "many")
    once = found.where("NOT many").select("node", "text")
    return stored(once.union(found.where("many").select("node", "text").dropDuplicates(["node"])), "texts")


def _overlap(a: str, b: str):
    """Least overlap of linked sets of these sizes."""
    return F.ceil((F.col(a) + F.col(b)) * F.lit(NUM) / F.lit(NUM + DEN))


def _needed(a: str, b: str):
    """How many prefix shingles linked sets of these sizes share: the overlap less what may lie behind the prefixes."""
    large = F.greatest(a, b)
    return F.greatest(F.lit(1), _overlap(a, b) + 1 - F.ceil(large * F.lit(NUM) / F.lit(DEN)))


def needed(a: int, b: int) -> int:
    return max(1, -(-(a + b) * NUM // (NUM + DEN)) + 1 - -(-max(a, b) * NUM // DEN))


def _may_link():
    """A pair that meets under a key (node, n, k and the same with _): sizes and numbers of keys allow a link."""
    small, large = F.least("n", "_n"), F.greatest("n", "_n")
    return (small * DEN >= large * NUM) & (F.least("k", "_k") >= _needed("n", "_n"))


def _may_be_first():
    """The key can be the first that a linked pair shares: enough lies behind it in both sets.

    A linked pair shares such a key; it may share others that cannot be the first,
    so shared keys must not be counted under this condition.
    """
    return 1 + F.least(F.col("n") - F.col("place") - 1, F.col("_n") - F.col("_place") - 1) >= _overlap("n", "_n")


def _leader_pairs(rows: DataFrame, turn: int, leaders: int) -> DataFrame:
    """Each class of a key with the key's leaders, if of another component: at most ``leaders`` pairs a row.

    Leaders are drawn among the classes with few prefix shingles of their own: such a
    class is close to the text that a group's copies were made from, and links with
    copies that differ too much from each other.  Leaders differ from key to key, so
    half of the needed keys is enough; what this misses is left to ``_all_pairs``.
    """
    w = Window.partitionBy("key")
    own = F.lit(1) - F.col("k") / _prefix_length()

    def draw(i: int):
        return F.pmod(F.xxhash64(F.lit(turn), F.lit(i), F.col("node")), F.lit(1 << 20)) / F.lit(1 << 20)

    lead = F.array(*[F.min(F.struct((own + draw(i) * LEADER_SPREAD).alias("h"), "node", "n", "k", "comp")).over(w) for i in range(leaders)])
    bare = F.transform("_leads", lambda x: F.struct(*[x[c].alias(c) for c in ("node", "n", "k", "comp")]))
    met = rows.withColumn("_leads", lead).withColumn("_l", F.explode(F.array_distinct(bare)))
    met = met.select("node", "n", "k", "comp", *[F.col(f"_l.{c}").alias(f"_{c}") for c in ("node", "n", "k", "comp")])
    met = met.where((F.col("comp") != F.col("_comp")) & _may_link())
    return (met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"), _needed("n", "_n").alias("needed"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed"))
            .where(F.col("met") * 2 >= F.col("needed")).select("a", "b"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of classes of different components that share the needed keys.

    Under keys of few classes pairs are joined; their number is linear in the
    rows, and their shared keys, rare or frequent, are counted then.  The classes of a frequent key are dealt in blocks of bounded size, and each pair
    of blocks counts the shared keys as a matrix product, which returns only
    the pairs that share enough.
    """
    sized = rows.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("key")))
    sets = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most a prefix of one text
    rare = sized.where(F.col("met") <= FREQUENT)
    other = rare.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "place", "k", "comp")])
    pairs = (rare.join(other, "key").where((F.col("node") < F.col("_node")) & (F.col("comp") != F.col("_comp")) & _may_link() & _may_be_first())
             .select(F.col("node").alias("a"), F.col("_node").alias("b"), _needed("n", "_n").alias("needed")).distinct())
    pairs = (pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("x")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("keys").alias("y")), "b")
             .where(F.size(F.array_intersect("x", "y")) >= F.col("needed")).select("a", "b"))

    blocks = F.ceil(F.col("met") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    often = sized.where(F.col("met") > FREQUENT).withColumn("blocks", blocks).withColumn("block", mine)
    units = (often.select("key", "node", "n", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
             .select("key", "node", "n", "comp", "block", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high")))
    heads = often.groupBy("node").agg(F.collect_list("key").alias("often"))
    counted = units.join(sets.join(heads, "node"), "node").groupBy("key", "low", "high").applyInArrow(_block_pairs, "a long, b long")
    return pairs.union(counted).distinct()


def _block_pairs(group: pa.Table) -> pa.Table:
    """Pairs of a unit's classes that share the needed keys; a unit of two blocks pairs only across.

    A pair meets under each frequent key it shares; the smallest of them returns it.
    """
    node, n, comp, block = (group[c].to_numpy() for c in ("node", "n", "comp", "block"))

    def holds(column: str) -> tuple[np.ndarray, np.ndarray]:
        """(class, key) of every key that two classes or more hold, sorted by key."""
        lists = group[column].combine_chunks()
        who = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        names, which, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        keep = times[which] > 1
        who, which = who[keep], which[keep]
        order = np.argsort(which, kind="stable")
        return who[order], names[which[order]]

    who, held = holds("keys")
    heads_of, heads = holds("often")
    often = [set() for _ in range(len(node))]
    for c, name in zip(heads_of.tolist(), heads.tolist(), strict=True):
        often[c].add(name)
    # shared keys of all pairs as matrix products, a bounded number of keys at a time
    column = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    shared = np.zeros((len(node), len(node)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, KEYS_AT_ONCE):
        x, y = np.searchsorted(column, [at, at + KEYS_AT_ONCE])
        has = np.zeros((len(node), min(KEYS_AT_ONCE, int(column[y - 1]) - at + 1)), np.float32)
        has[who[x:y], column[x:y] - at] = 1
        shared += has @ has.T
    key = group["key"][0].as_py()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    one = bool((block == block[0]).all())
    for i in range(len(node)):
        small, large = np.minimum(n[i], n), np.maximum(n[i], n)
        least = np.maximum(1, -(-(small + large) * NUM // (NUM + DEN)) + 1 - -(-large * NUM // DEN))
        ok = (shared[i] >= least) & (small * DEN >= large * NUM) & (comp != comp[i]) & (node > node[i])
        if not one:
            ok &= block != block[i]
        js = [j for j in np.flatnonzero(ok).tolist() if min(often[i] & often[j]) == key]
        a.append(np.full(len(js), node[i]))
        b.append(node[js])
    return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def _with_components(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Postings with their class's component, of keys that still join different components."""
    if comps is None:
        return postings.withColumn("comp", F.col("node"))
    rows = postings.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    w = Window.partitionBy("key")
    return (rows.withColumn("_low", F.min("comp").over(w)).withColumn("_high", F.max("comp").over(w))
            .where("_low <> _high").drop("_low", "_high"))


def _verify(pairs: DataFrame, texts: DataFrame, levels) -> DataFrame:
    """The pairs that link: they must pass the prefixes of all other orders, then their sets are intersected."""
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def linked(x: np.ndarray, y: np.ndarray, prefix_x: list, prefix_y: list) -> bool:
        small, large = sorted((len(x), len(y)))
        if not small or DEN * small < NUM * large:
            return False
        least = needed(len(x), len(y))
        if any(np.intersect1d(p, q, assume_unique=True).size < least for p, q in zip(prefix_x, prefix_y, strict=True)):
            return False
        both = np.intersect1d(x, y, assume_unique=True).size
        return DEN * both >= NUM * (len(x) + len(y) - both)

    def prefixes(s: np.ndarray, levels: np.ndarray) -> list:
        m = int(prefix_length(len(s))) if len(s) else 0
        out = []
        for o in range(1, len(ORDERS)):
            key = order_key(s, o, levels)
            out.append(s[np.argpartition(key, m - 1)[:m]] if 0 < m < len(s) else s)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ok = np.zeros(part.num_rows, bool)
                sets: dict[str, list] = {"x": [], "y": []}
                for side in sets:
                    for _, _, shingles, n in texts_in(part, side):
                        sets[side] += np.split(shingles, np.cumsum(n)[:-1])
                memo: dict[int, list] = {}
                lead = part.column("b").to_numpy()
                for i, (s, t) in enumerate(zip(sets["x"], sets["y"], strict=True)):
                    if lead[i] not in memo:
                        memo = {lead[i]: prefixes(t, levels.value)}
                    ok[i] = linked(s, t, prefixes(s, levels.value), memo[lead[i]])
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok))

    met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a long, b long").distinct()


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def _row_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, component_id, stays): one row per document row; h is its text's hash.

    ``stays`` marks the row that stands for its component: the representative of the
    component's class with the smallest doc_id; rows without words stand for themselves.
    """
    docs = _hashed(docs)
    signed = stored(_signatures(docs), "signatures")
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(_sketch(signed)))
    rows = signed.where("chunk IS NULL").select("doc_id", "h", "n", "s1", "s2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r")
    classes = stored(rows.where("n > 0").groupBy("n", "s1", "s2").agg(first).select(
        "n", "s1", "s2", "r.doc_id", "r.h").withColumn("node", F.monotonically_increasing_id()), "classes")
    postings = _postings(docs, classes, levels)
    texts = _texts(docs, rows, classes, postings)
    comps, links, seen = None, None, None
    for turn in range(len(STARS) + 1):
        left = _with_components(postings, comps)
        pairs = _leader_pairs(left, turn, STARS[turn]) if turn < len(STARS) else _all_pairs(left)
        pairs = stored(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = pairs if seen is None else seen.union(pairs)
        new = stored(_verify(pairs, texts, levels), "links")
        if not new.limit(1).count():
            continue
        links = new if links is None else links.union(new)
        comps = components(links)
    if comps is None:
        named = classes.select("n", "s1", "s2", F.col("doc_id").alias("_rep"), F.col("h").alias("_h"), F.col("doc_id").alias("_name"), F.lit(True).alias("_leads"))
    else:
        # the first class of each component, by its representative, names it
        joined = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        lead = joined.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "node")).alias("l"))
        named = joined.join(lead, "comp").select("n", "s1", "s2", F.col("doc_id").alias("_rep"), F.col("h").alias("_h"), F.col("l.doc_id").alias("_name"),
                                                 (F.col("l.node") == F.col("node")).alias("_leads"))
    out = rows.join(named, ["n", "s1", "s2"], "left")
    stays = (F.col("n") == 0) | (F.col("_leads") & F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("h") == F.col("_h")))
    return out.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("_name")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document row.

    A document without words, or with a NULL text, has 0 shingles and is linked
    with nothing: its component is itself.  With fewer than 5 words the whole
    sequence is the one shingle.  Repeated rows and equal texts are in one
    component.  A NULL doc_id links like any other text but is never a
    component's name (NULL if the whole component has none).  Rows of one doc_id with different texts are
    judged each by its own text.  Extra columns are not read; an empty table gives no rows.
    """
    return _row_classes(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns unchanged: of its texts with the smallest doc_id the one of smallest hash.

    Rows without words and rows without doc_id are all kept.  Rows of one doc_id are judged each by its own
    text; of repeated rows of the same doc_id and text that stays, one stays.
    """
    judged = _row_classes(docs).where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.max("stays").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    verdicts = stored(judged.where("NOT _stays OR _rows > 1"), "verdicts")
    side, _ = bounded_broadcast(verdicts.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_stays", "_rows"), MAX_BROADCAST_IDS)
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = hashed.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left").where("coalesce(_stays, true)")
    once = found.where("_rows IS NULL")
    again = found.where("_rows IS NOT NULL").dropDuplicates(["_id", "_h"])
    return once.unionByName(again).drop("_hash", "_id", "_h", "_stays", "_rows")

"""Exact best class of a text by term-count cosine, with score bounds per term.

The classes' postings are shipped to the tasks, a bounded block at a time, and only
the term arrays of the rows cross to Python.  A row's terms are taken from the one
that fewest classes hold.  Each term can add at most its count times its highest class weight, so
once the terms left cannot lift a class that none of the earlier ones names above
the best score so far, their postings are not read; the classes still in the running are
scored exactly, term by term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.session import cut_lineage

# Rows (class, term) of one shipped block.
MAX_CLASS_TERMS = 500_000
# Rows x classes, tokens, and postings worked on at once.
CELLS = 1 << 21
# Postings of the rarest terms that give a row its first threshold.
FIRST = 64
# Scores that round to the same number at so many digits are ties.
TIE_DIGITS = 9


class TermIndex:
    """Classes by scope and key, with their postings."""

    def __init__(self, scopes: list[str], keys: list, terms: list[str], tf: list[int]):
        scope_names, scope = np.unique(np.array(scopes, object), return_inverse=True) if scopes else (np.zeros(0, object), np.zeros(0, np.int64))
        self.scope_names = pa.array(scope_names.tolist(), pa.string())
        vocab, term = np.unique(np.array(terms, object), return_inverse=True) if terms else (np.zeros(0, object), np.zeros(0, np.int64))
        self.vocab, self.v = pa.array(vocab.tolist(), pa.string()), max(1, len(vocab))
        key, count = np.array(keys), np.array(tf, np.int64)
        # classes in order of key: the first of equals has the lowest
        order = np.lexsort((term, scope, key))
        scope, term, key, count = scope[order], term[order], key[order], count[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (scope[1:] != scope[:-1])
        item = np.cumsum(new) - 1
        self.keys, self.n = key[new], int(new.sum())
        self.norm = np.sqrt(np.bincount(item, weights=count.astype(float) ** 2, minlength=self.n))
        self.item_term, self.item_tf = item * self.v + term, count  # ascending
        by = np.argsort(scope * self.v + term, kind="stable")
        code = (scope * self.v + term)[by]
        self.posted, self.weight = item[by], count[by] / self.norm[item[by]]
        self.codes, self.start = np.unique(code, return_index=True)
        self.size = np.diff(np.append(self.start, len(code)))
        self.top = np.maximum.reduceat(self.weight, self.start) if len(code) else np.zeros(0)

    def _spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, posting) of all postings of the codes at these places."""
        size = self.size[at]
        who = np.repeat(np.arange(len(at)), size)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + self.start[at][who]

    def best(self, terms: pa.Array, scope: pa.Array | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Place of each row's best class (-1: no term in common), its cosine, and how many pairs were scored exactly."""
        n = len(terms)
        place, cosine, scored = np.full(n, -1), np.zeros(n), 0
        size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n and self.n:
            room = max(1, CELLS // self.n)
            stop = min(n, at + room, max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + CELLS, side="right"))))
            a, b, c = self._some(terms.slice(at, stop - at), size[at:stop], None if scope is None else scope.slice(at, stop - at))
            place[at:stop], cosine[at:stop], scored = a, b, scored + c
            at = stop
        return place, cosine, scored

    def _some(self, terms: pa.Array, size: np.ndarray, scope: pa.Array | None) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(size)
        none = np.full(n, -1), np.zeros(n), 0
        coded = terms.flatten().dictionary_encode()
        if not len(coded):
            return none
        known = pc.index_in(coded.dictionary, value_set=self.vocab)
        width = len(coded.dictionary)
        # distinct terms of each row with their counts
        pair, count = np.unique(np.repeat(np.arange(n), size) * width + coded.indices.to_numpy(), return_counts=True)
        row = pair // width
        norm = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=n))
        term = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)[pair % width]
        in_scope = np.zeros(n, np.int64) if scope is None else pc.fill_null(pc.index_in(scope, value_set=self.scope_names), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        use = (term >= 0) & (in_scope[row] >= 0)
        row, term, count = row[use], term[use], count[use]
        code = in_scope[row] * self.v + term
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        use = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        row, term, count, at = row[use], term[use], count[use], at[use]
        if not len(row):
            return none
        # each row's terms, the one of fewest classes first
        order = np.lexsort((at, self.size[at], row))
        row, term, count, at = row[order], term[order], count[order], at[order]
        first = np.searchsorted(row, np.arange(n))
        last = np.searchsorted(row, np.arange(n), side="right")
        bound = count * self.top[at]
        total = np.concatenate([[0.0], np.cumsum(bound)])
        rest = total[last[row]] - total[np.arange(len(row))]  # of this term and all after it
        read = np.concatenate([[0], np.cumsum(self.size[at])])
        early = (read[np.arange(len(row)) + 1] - read[first[row]] <= FIRST) | (np.arange(len(row)) == first[row])

        def sums(some: np.ndarray) -> np.ndarray:
            who, posting = self._spread(at[some])
            cell = row[some][who] * self.n + self.posted[posting]
            return np.bincount(cell, weights=count[some][who] * self.weight[posting], minlength=n * self.n).reshape(n, self.n)

        # what rounding to TIE_DIGITS can hide, in terms of a dot product
        slack = 10.0 ** -TIE_DIGITS * 2 * norm + 1e-12
        least = sums(np.flatnonzero(early)).max(axis=1) - slack
        essential = early | (rest >= least[row])
        part = sums(np.flatnonzero(essential))
        left = np.bincount(row[~essential], weights=bound[~essential], minlength=n)
        least = np.maximum(least, part.max(axis=1) - slack)
        who, item = np.nonzero((part > 0) & (part + left[:, None] >= least[:, None]))
        dot = np.zeros(len(who), np.int64)
        span = (last - first)[who]
        for a in range(0, len(who), max(1, CELLS // max(1, int(span.max())))):
            b = min(len(who), a + max(1, CELLS // max(1, int(span.max()))))
            pick = np.repeat(np.arange(a, b), span[a:b])
            entry = np.arange(len(pick)) - np.repeat(np.cumsum(span[a:b]) - span[a:b], span[a:b]) + first[who[pick]]
            key = item[pick] * self.v + term[entry]
            found = np.minimum(np.searchsorted(self.item_term, key), len(self.item_term) - 1)
            hit = self.item_term[found] == key
            dot += np.bincount(pick[hit], weights=(count[entry[hit]] * self.item_tf[found[hit]]).astype(float), minlength=len(who)).astype(np.int64)
        cosine = dot / (norm[who] * self.norm[item])
        ranked = np.lexsort((item, -np.round(cosine, TIE_DIGITS), who))
        lead = ranked[np.concatenate([[True], who[ranked][1:] != who[ranked][:-1]])] if len(ranked) else ranked
        best, value = np.full(n, -1), np.zeros(n)
        best[who[lead]], value[who[lead]] = item[lead], cosine[lead]
        return best, value, len(who)


def _shipped(block: DataFrame, scope: list[str], key: str):
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in scope]) if scope else F.lit("")
    rows = block.where(F.col("term").isNotNull() & F.col(key).isNotNull()).select(name.alias("s"), F.col(key).alias("k"), "term", "tf").toArrow()
    index = TermIndex(rows["s"].to_pylist(), rows["k"].to_pylist(), rows["term"].to_pylist(), rows["tf"].to_pylist())
    return block.sparkSession.sparkContext.broadcast(index)


def best_class(rows: DataFrame, terms: Column, class_terms: DataFrame, scope: list[str], key: str, max_terms: int | None = None) -> DataFrame:
    """``rows`` with ``key`` (NULL: no term in common with any class) and ``cosine`` (then 0) of the best class of the same scope.

    ``class_terms``: scope columns, ``key`` (a number), term and tf.  Ties, by the cosine rounded to ``TIE_DIGITS`` digits, go to the lowest key.
    A class side of more than ``max_terms`` rows is taken in blocks, and the rows are written to the shared
    checkpoint folder between them.
    """
    key_type = class_terms.schema[key].dataType.simpleString()
    arrow_type = {"int": pa.int32(), "bigint": pa.int64()}.get(key_type)
    if arrow_type is None:
        raise TypeError(f"{key} must be int or bigint, not {key_type}")
    n = class_terms.count()
    n_blocks = max(1, -(-n // (max_terms or MAX_CLASS_TERMS)))
    schema = f"struct<key:{key_type},cosine:double>"

    def column(shipped) -> Column:
        def answer(index: TermIndex, t: pa.Array, s: pa.Array | None) -> pa.Array:
            place, cosine, _ = index.best(t, s)
            keys = pa.array(index.keys.tolist(), arrow_type).take(pa.array(np.maximum(place, 0))) if index.n else pa.nulls(len(t), arrow_type)
            return pa.StructArray.from_arrays([pc.if_else(pa.array(place >= 0), keys, pa.scalar(None, arrow_type)), pa.array(cosine)], names=["key", "cosine"])

        if not scope:
            def alone(t: pa.Array) -> pa.Array:
                return answer(shipped.value, t, None)
            return F.arrow_udf(alone, schema)(terms)

        def scoped(t: pa.Array, s: pa.Array) -> pa.Array:
            return answer(shipped.value, t, s)
        return F.arrow_udf(scoped, schema)(terms, F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in scope]))

    out = rows
    for k in range(n_blocks):
        block = class_terms if n_blocks == 1 else class_terms.where(F.pmod(F.xxhash64(*scope, key), F.lit(n_blocks)) == k)
        shipped = _shipped(block, scope, key)
        out = out.withColumn("_new", column(shipped))
        if k:
            better = F.col("_new.key").isNotNull() & (F.col("_best.key").isNull() | (F.round("_new.cosine", TIE_DIGITS) > F.round("_best.cosine", TIE_DIGITS)) | (
                (F.round("_new.cosine", TIE_DIGITS) == F.round("_best.cosine", TIE_DIGITS)) & (F.col("_new.key") < F.col("_best.key"))))
            out = out.withColumn("_best", F.when(better, F.col("_new")).otherwise(F.col("_best"))).drop("_new")
        else:
            out = out.withColumnRenamed("_new", "_best")
        if n_blocks > 1:
            out = cut_lineage(out)
            shipped.unpersist()
    return out.withColumn(key, F.col("_best.key")).withColumn("cosine", F.col("_best.cosine")).drop("_best")

"""Sparse text vectors and nearest-neighbour by cosine over shared terms.

The reference embeds answers and class prompts with an external text
encoder; here the default encoder is relational term counts (word tokens or
character trigrams).  The best class of a text comes from ``maxscore``, which reads only
the postings that can still decide.  All similarities of a text (``token_cosine``) are computed with an
inverted-index equi-join on the term instead of a dense items x classes product:

1. the query side (documents / answers) is hash-partitioned once by its key;
   term counting, the join with the (size-checked, broadcast) class terms,
   the per-(item, class) dot products and the per-item arg-max then all run
   on that partitioning without another exchange;
2. beyond the broadcast bound the class terms are shuffled on the term and
   AQE's skew-join splitting handles very frequent terms.

A dense external encoder can be plugged in with :func:`encode_with`, which
runs one model instance per partition over Arrow batches.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.functions.text import ColumnOrName, _c
from scorecraft.operators.maxscore import best_class
from scorecraft.session import bounded_broadcast, suggested_partitions

WORD = r"[\p{L}\p{N}]+"
# Rows of (scope, class, term, tf, norm) we broadcast (~50 MB); beyond it the class
# terms are shuffle-joined on the term.
MAX_CLASS_TERMS = 500_000


def terms(text: ColumnOrName, analyzer: str = "word") -> Column:
    """Array of terms of the lower-cased text."""
    t = F.lower(_c(text))
    if analyzer == "word":
        return F.regexp_extract_all(t, F.lit(WORD), 0)
    if analyzer == "char3":
        return F.when(F.length(t) >= 3, F.transform(
            F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, 3))
        ).otherwise(F.array().cast("array<string>"))
    raise ValueError(f"unknown analyzer {analyzer!r}")


def _keys(k: str | Sequence[str]) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def term_counts(df: DataFrame, key: str | Sequence[str], text: str, analyzer: str = "word") -> DataFrame:
    """``(key..., norm, term, tf)``: one tokenisation per row; ``norm`` is the row's L2 norm."""
    keys = _keys(key)
    # explode_outer keeps rows without any term (one NULL term, tf 0), so a
    # text with no terms still yields its row downstream.
    tc = (df.select(*keys, F.explode_outer(terms(text, analyzer)).alias("term"))
            .groupBy(*keys, "term").agg(F.count("term").alias("tf")))
    # Row norm as a window over the row's own terms: on input partitioned by
    # the keys this is an in-partition sort, with no second tokenisation and
    # no exchange.
    return tc.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(*keys))))


def _partitioned(left: DataFrame, keys: list[str], partitions: int | None, prepartitioned: bool) -> DataFrame:
    """Hash-partition by the row keys; the count follows the input size (about 256 MB per task)."""
    if prepartitioned:
        return left
    return left.repartition(partitions or suggested_partitions(left), *keys)


def token_cosine(left: DataFrame, left_key: str | Sequence[str], left_text: str,
                 right: DataFrame, right_key: str | Sequence[str], right_text: str,
                 analyzer: str = "word", scope: Sequence[str] = (),
                 partitions: int | None = None, prepartitioned: bool = False,
                 keep_unmatched: bool = False) -> DataFrame:
    """``(scope..., left_key..., right_key..., dot, cosine)`` for pairs sharing a term.

    ``keep_unmatched``: left rows sharing no term also yield one row with a
    NULL right key (left outer join on the term).

    ``right`` is the bounded side (classes / benchmark items).  ``scope``
    columns (e.g. the run) restrict pairs to rows with equal scope values.
    ``prepartitioned``: ``left`` is already hash-partitioned by its keys.
    """
    scope = list(scope)
    lk = [k for k in _keys(left_key) if k not in scope]
    rk = [k for k in _keys(right_key) if k not in scope]
    r_side = (term_counts(right, scope + rk, right_text, analyzer)
              .select(*scope, *rk, "term", F.col("tf").alias("r_tf"), F.col("norm").alias("r_norm")))
    r_side, _ = bounded_broadcast(r_side, MAX_CLASS_TERMS)

    base = _partitioned(left.select(*scope, *lk, left_text), scope + lk, partitions, prepartitioned)
    l_tc = term_counts(base, scope + lk, left_text, analyzer)
    dots = (l_tc.join(r_side, scope + ["term"], "left" if keep_unmatched else "inner")
                .groupBy(*scope, *lk, *rk)
                .agg(F.sum(F.col("tf") * F.col("r_tf")).cast("double").alias("dot"),
                     F.first("norm").alias("norm"), F.first("r_norm").alias("r_norm")))
    return dots.select(*scope, *lk, *rk, "dot", (F.col("dot") / (F.col("norm") * F.col("r_norm"))).alias("cosine"))


def token_nearest(left: DataFrame, left_key: str | Sequence[str], left_text: str,
                  right: DataFrame, right_key: str, right_text: str,
                  analyzer: str = "word", scope: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Best ``right_key`` per left row by cosine; lowest key wins ties (cosines equal to 9 digits).

    Rows sharing no term with any candidate keep ``right_key`` NULL and cosine 0.
    ``keep`` lists extra left columns to carry.  Every left row is answered by
    itself, rows with equal keys too; the left side is neither shuffled nor exploded.
    """
    scope = list(scope)
    cols = list(dict.fromkeys([*scope, *_keys(left_key), *keep]))
    r_side = term_counts(right, [*scope, right_key], right_text, analyzer).select(*scope, right_key, "term", "tf")
    rows = left.select(*cols, *([] if left_text in cols else [left_text])).withColumn("_terms", terms(left_text, analyzer))
    best = best_class(rows, F.col("_terms"), r_side, scope, right_key)
    return best.select(*cols, right_key, "cosine")


def encode_with(df: DataFrame, text: str, out: str, make_encoder: Callable[[], Callable],
                batch_rows: int = 256) -> DataFrame:
    """Dense plug-in encoder: ``make_encoder()`` is called once per partition.

    The returned callable maps a list of strings to a 2-D array-like.  Rows
    arrive as Arrow batches and are encoded ``batch_rows`` at a time (the
    model's batch size), so the model is loaded once per task, not per row.
    """
    import numpy as np
    import pandas as pd

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = make_encoder()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            vecs = [np.asarray(enc(texts[i:i + batch_rows]), dtype=np.float32)
                    for i in range(0, len(texts), batch_rows)]
            mat = np.vstack(vecs) if vecs else np.zeros((0, 0), dtype=np.float32)
            pdf[out] = list(mat)
            yield pdf

    return df.mapInPandas(run, schema)

"""Column builders for dense vectors stored as ``ARRAY<FLOAT|DOUBLE>``.

Accumulation is done in DOUBLE.  Spark has no built-in cosine similarity, so
norms and dot products are written with higher-order functions; they stay
inside the JVM and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorecraft.functions.text import ColumnOrName, _c

def _zero() -> Column:
    return F.lit(0.0).cast("double")


def as_double(v: ColumnOrName) -> Column:
    return _c(v).cast("array<double>")


def l2_norm(v: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(as_double(v), _zero(), lambda acc, x: acc + x * x))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       _zero(), lambda acc, x: acc + x)


def cosine(a: ColumnOrName, b: ColumnOrName, norm_a: Column | None = None,
           norm_b: Column | None = None) -> Column:
    """dot / (|a| |b|); a zero norm gives NULL instead of NaN."""
    na = l2_norm(a) if norm_a is None else norm_a
    nb = l2_norm(b) if norm_b is None else norm_b
    return F.try_divide(dot(a, b), F.nullif(na * nb, _zero()))


def best_of(scored: Column) -> Column:
    """Arg-max over an array of ``struct(sim, class_idx, ...)`` ordered by class_idx.

    The first index wins ties; NULL similarities are never chosen.
    """
    first = F.get(scored, 0)
    return F.aggregate(
        scored, F.when(first.isNotNull(), first),
        lambda acc, s: F.when(
            s["sim"].isNotNull() & (acc["sim"].isNull() | (s["sim"] > acc["sim"])), s
        ).otherwise(acc),
    )

"""Exact best class with score bounds against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scorecraft.operators.encode import token_nearest
from scorecraft.operators.maxscore import TermIndex


def brute(rows, classes):
    """(scope, terms) rows and (scope, key, terms) classes -> (key, cosine)."""
    out = []
    for scope, terms in rows:
        best = None
        x = Counter(terms)
        for s, key, other in classes:
            y = Counter(other)
            dot = sum(c * y[t] for t, c in x.items())
            if s == scope and dot:
                cos = dot / (math.sqrt(sum(c * c for c in x.values())) * math.sqrt(sum(c * c for c in y.values())))
                rank = (-round(cos, 9), key)
                if best is None or rank < best[0]:
                    best = rank, key, cos
        out.append(best[1:] if best else (None, 0.0))
    return out


def words(r, n, zipf=1.1, vocabulary=400):
    weights = [1 / (k + 1) ** zipf for k in range(vocabulary)]
    return [f"w{k}" for k in r.choices(range(vocabulary), weights, k=n)]


@pytest.mark.parametrize("seed", range(4))
def test_best_equals_all_pairs(seed):
    r = random.Random(seed)
    classes = [(r.choice("ab"), k, words(r, r.choice([1, 3, 20]))) for k in range(300)]
    classes += [(s, k + 1000, t) for s, k, t in classes[:40]]  # equal texts: the lowest key wins
    rows = [(r.choice("abc"), words(r, r.choice([0, 1, 5, 60, 400]))) for _ in range(200)]
    flat = [(s, k, t, c) for s, k, ts in classes for t, c in Counter(ts).items()]
    index = TermIndex(*map(list, zip(*flat)))
    place, cosine, scored = index.best(pa.array([t for _, t in rows], pa.list_(pa.string())), pa.array([s for s, _ in rows]))
    got = [(int(index.keys[p]) if p >= 0 else None, c) for p, c in zip(place, cosine)]
    for g, w in zip(got, brute(rows, classes), strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-12


def test_bounds_spare_most_pairs():
    r = random.Random(7)
    classes = [("", k, words(r, 40, 1.0, 5000)) for k in range(500)]
    rows = [words(r, 10, 1.0, 5000) + r.choice(classes)[2][:30] for _ in range(300)]
    flat = [(s, k, t, c) for s, k, ts in classes for t, c in Counter(ts).items()]
    index = TermIndex(*map(list, zip(*flat)))
    _, _, scored = index.best(pa.array(rows, pa.list_(pa.string())), None)
    assert scored < 0.1 * len(rows) * len(classes)


def test_rows_of_equal_keys_and_odd_texts(spark):
    left = spark.createDataFrame([(1, "red apple", "p"), (1, "blue sky", "q"), (1, "red apple", "p"), (None, "sky", "r"), (2, None, "s"), (3, "", "t"),
                                  (4, "zzz " * 20_000, "u"), (5, "red " * 50_000 + "sky", "v")], "k int, text string, more string")
    right = spark.createDataFrame([(7, "red apple"), (8, "blue sky"), (9, None), (None, "red apple"), (10, "red apple")], "c int, label string")
    got = sorted(((r["k"], r["more"], r["c"], round(r["cosine"], 6)) for r in token_nearest(left, "k", "text", right, "c", "label", keep=["more"]).collect()), key=repr)
    assert got == sorted([(1, "p", 7, 1.0), (1, "p", 7, 1.0), (1, "q", 8, 1.0), (None, "r", 8, 0.707107), (2, "s", None, 0.0), (3, "t", None, 0.0),
                          (4, "u", None, 0.0), (5, "v", 7, 0.707107)], key=repr)
    assert token_nearest(left, "k", "text", right.limit(0), "c", "label").where("c IS NULL").count() == 8


def test_blocks_of_classes_give_the_same(spark, monkeypatch):
    from scorecraft.operators import maxscore
    r = random.Random(3)
    left = spark.createDataFrame([(k, r.choice("ab"), " ".join(words(r, 30))) for k in range(120)], "k int, run string, text string")
    right = spark.createDataFrame([(k % 70, "ab"[k // 70], " ".join(words(r, 6))) for k in range(140)], "c int, run string, label string")

    def snap():
        return sorted((x["k"], x["c"], round(x["cosine"], 9)) for x in token_nearest(left, "k", "text", right, "c", "label", scope=["run"]).collect())

    one = snap()
    monkeypatch.setattr(maxscore, "MAX_CLASS_TERMS", 150)
    assert snap() == one and len({x[1] for x in one}) > 20

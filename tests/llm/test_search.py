"""Vector searches against brute force."""

import numpy as np
import pytest

from scorecraft.llm.permutation_index import nearest
from scorecraft.llm.topk import top_products

SCHEMA = "vec_id long, embedding array<float>, score string, data int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    x = (r.standard_normal((700, 8)) * r.choice([0.2, 1, 5], (700, 1))).astype(np.float32)
    x[100:250] = x[100]  # many equal vectors
    out = [(i, [float(v) for v in x[i]]) for i in range(700)]
    bad = [(800, None), (None, out[0][1]), (900, [float("nan")] + [0.0] * 7), (1000, [None] + [1.0] * 7), (1100, [float("inf")] * 8),
           (1200, [1.0, 2.0]), (1300, []), (1400, [0.0] * 8)]
    return out + bad + out[:3]


def brute(rows, every, k, score, zero):
    seen = {i: v for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}
    out = []
    for q in sorted(i for i in seen if i % every == 0):
        best = sorted((score(np.array(seen[q]), np.array(v)), i) for i, v in seen.items() if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def test_exact_topk(spark, rows):
    want = brute(rows, 50, 5, lambda a, b: -int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int)), True)
    got = sorted(map(tuple, top_products(frame(spark, rows), block=64).collect()))
    assert got == [(q, r, i, -s) for q, r, i, s in want]


def test_permutation_index_recall_and_scores(spark, rows):
    want = brute(rows, 100, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    got = sorted(map(tuple, nearest(frame(spark, rows), block=128).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    best = {(q, i): s for q, _, i, s in want}
    assert len({g[:1] + g[2:3] for g in got} & set(best)) >= 0.9 * len(want)
    assert all(abs(s - best[q, i]) < 1e-12 for q, _, i, s in got if (q, i) in best)


def test_recall_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in t.collect()]
    x = np.array([v for _, v in rows], float)
    found = {}
    for r in nearest(t).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            hits += len({rows[j][0] for j in np.argsort(d)[:10]} & found[q])
            total += 10
    assert hits / total >= 0.9


def test_few_and_no_rows(spark, rows):
    for f in (nearest, top_products):
        assert f(frame(spark, [])).count() == 0
        assert f(frame(spark, [(0, None)])).count() == 0
        assert f(frame(spark, [(0, [1.0] * 8)])).count() == 0
        assert [(r["query_id"], r["vec_id"]) for r in f(frame(spark, [(0, [1.0] * 8), (1, [1.0] * 8)])).collect()] == [(0, 1)]


@pytest.mark.parametrize("noise", [0.0, 1e-3])
def test_recall_beside_many_copies(spark, noise):
    """A third of the rows are copies, or near copies, of one vector; queries are the others, over several blocks."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in t], np.float32)
    r = np.random.default_rng(5)
    copies = np.repeat(x[:1], len(x) // 2, axis=0) + (noise * r.standard_normal((len(x) // 2, x.shape[1]))).astype(np.float32)
    rows = [(2 * i, [float(a) for a in v]) for i, v in enumerate(x)] + [(2 * i + 1, [float(a) for a in v]) for i, v in enumerate(copies)]
    everything = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    found = {}
    for row in nearest(frame(spark, rows), every=20, block=512).collect():
        found.setdefault(row["query_id"], []).append(row["score"])
    hits = total = 0
    for i, q in enumerate(ids[:len(x)]):
        if q % 20 == 0 and i:
            d = np.sqrt(((everything - everything[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            hits += sum(s <= np.sort(d)[9] + 1e-9 for s in found[q])
            total += 10
    print(f"recall beside copies, noise {noise}: {hits / total:.3f} of {total}")
    assert hits / total >= 0.95


def test_rows_of_one_id_all_count(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 5.0]), (1, [5.0, 5.0]), (2, [0.5, 0.0]), (50, [1.0, 0.0]), (100, [-1.0, 0.0]), (100, [2.0, 0.0])]
    got = [tuple(r) for r in top_products(frame(spark, rows)).collect()]
    assert (0, 1, 1, 327680) in got and (0, 2, 100, 131072) in got and (0, 3, 1, 65536) in got
    assert sorted(g[1:] for g in got if g[0] == 100 and g[1] == 1) == [(1, 1, 655360), (1, 2, -32768)]
    near = [tuple(r) for r in nearest(frame(spark, rows)).collect()]
    assert [n[2] for n in sorted(near) if n[0] == 0] == [50, 2, 1, 100, 100, 1]
    assert len([n for n in near if n[0] == 100]) == 10


def test_products_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_products(frame(spark, [(0, [1e17, 0.0]), (1, [1e17, 1.0])])).collect()

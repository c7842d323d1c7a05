"""Nearest class / softmax / zero-shot against NumPy brute force."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorecraft.operators import nearest as N


def test_nearest_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    cent = N.class_centroids(emb, "label", "embedding").select(
        F.col("label").alias("class_idx"), F.col("label").cast("string").alias("class_label"), "class_vec")
    got = {r["vec_id"]: (r["predicted_idx"], r["sim"]) for r in
           N.nearest_class(emb, "embedding", cent).select("vec_id", "predicted_idx", "sim").collect()}
    pdf = emb.toPandas()
    X = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    labels = sorted(pdf["label"].unique())
    C = np.stack([X[pdf["label"].values == k].mean(axis=0) for k in labels])
    S = (X @ C.T) / np.outer(np.linalg.norm(X, axis=1), np.linalg.norm(C, axis=1))
    best = S.argmax(axis=1)
    for i, vid in enumerate(pdf["vec_id"]):
        idx, sim = got[vid]
        assert labels[best[i]] == idx
        assert abs(S[i, best[i]] - sim) < 1e-9


def test_ties_zero_vectors_and_softmax(spark):
    classes = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "c", [0.0, 1.0])],
                                    "class_idx int, class_label string, class_vec array<double>")
    items = spark.createDataFrame([(1, [2.0, 0.0], "a"), (2, [0.0, 0.0], "c"), (3, [0.0, 3.0], "c")],
                                  "id int, v array<double>, gt string")
    out = {r["id"]: r for r in N.nearest_class(items, "v", classes).collect()}
    assert out[1]["predicted_label"] == "a"            # tie between a and b: first index wins
    assert out[2]["sim"] is None and out[2]["zero_norm"]
    assert out[3]["predicted_label"] == "c"
    sm = N.class_softmax(items.where("id != 2"), "v", classes, keep=["id"])
    sums = {r["id"]: r["s"] for r in sm.groupBy("id").agg(F.sum("prob").alias("s")).collect()}
    assert all(abs(s - 1.0) < 1e-12 for s in sums.values())
    zs = {r["id"]: r for r in N.zero_shot(items.where("id != 2"), "v", "gt", classes).collect()}
    assert zs[3]["correct"] and zs[1]["correct"]


def test_blocked_classes_match_single_block(spark, monkeypatch):
    """Class sides above the shipping bound are scored in blocks with an exact merge."""
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    cent = N.class_centroids(emb, "label", "embedding").select(
        F.col("label").alias("class_idx"), F.col("label").cast("string").alias("class_label"), "class_vec")
    items = emb.select("vec_id", "embedding", "label")

    def snap():
        near = {r["vec_id"]: (r["predicted_idx"], round(r["sim"], 9))
                for r in N.nearest_class(items, "embedding", cent).collect()}
        zs = {r["vec_id"]: (r["predicted_idx"], round(r["prob"], 9))
              for r in N.zero_shot(items, "embedding", "label", cent).collect()}
        sm = {(r["vec_id"], r["class_idx"]): round(r["prob"], 9)
              for r in N.class_softmax(items, "embedding", cent, keep=["vec_id"]).collect()}
        cm = N.cosine_matrix(items, "embedding", cent, keep=["vec_id"]).count()
        return near, zs, sm, cm

    one = snap()
    monkeypatch.setattr(N, "MAX_CLASS_CELLS", 64 * 3)   # 3 classes per block -> 4 blocks
    assert len(N.class_blocks(cent, "class_idx", "class_vec")) == 4
    many = snap()
    assert one == many


def _odd(spark):
    nan, inf = float("nan"), float("inf")
    classes = [(0, "zero", [0.0, 0.0]), (None, "no index", [1.0, 0.0]), (3, "b", [0.0, 1.0]), (2, "a", [1.0, 0.0]), (5, "a again", [2.0, 0.0]),
               (6, "longer", [1.0, 1.0, 1.0]), (7, "null", None), (8, "null inside", [None, 1.0]), (9, "nan", [nan, 1.0]), (10, None, [-1.0, -1.0])]
    items = [(1, [3.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.5, 0.4, 0.6]),
             (9, [1.0]), (9007199254740993, [-2.0, -2.0]), (None, [0.0, 5.0])]
    return (spark.createDataFrame(items, "id long, v array<double>"),
            spark.createDataFrame(classes, "class_idx int, class_label string, class_vec array<double>"))


def test_odd_vectors_are_alike_at_every_block_size(spark, monkeypatch):
    items, classes = _odd(spark)
    want = {1: (2, "a", True, False), 2: (0, "zero", False, True), 3: (0, "zero", False, True), 4: (0, "zero", False, True), 5: (0, "zero", False, True),
            6: (0, "zero", False, True), 7: (0, "zero", False, True), 8: (6, "longer", True, False), 9: (0, "zero", False, False),
            9007199254740993: (10, None, True, False), None: (3, "b", True, False)}
    for cells in (4_000_000, 9, 3):
        monkeypatch.setattr(N, "MAX_CLASS_CELLS", cells)
        out = N.nearest_class(items, "v", classes, logit_scale=100.0)
        assert out.dtypes == [("id", "bigint"), ("v", "array<double>"), ("predicted_idx", "int"), ("predicted_label", "string"),
                              ("sim", "double"), ("zero_norm", "boolean"), ("prob", "double")]
        assert {r["id"]: (r["predicted_idx"], r["predicted_label"], r["sim"] is not None, r["zero_norm"]) for r in out.collect()} == want
        sums = {r["id"]: r["s"] for r in N.class_softmax(items, "v", classes, keep=["id"]).groupBy("id").agg(F.sum("prob").alias("s")).collect()}
        assert all(abs(s - 1) < 1e-12 if want[i][2] else s is None for i, s in sums.items()) and len(sums) == 11
        assert N.cosine_matrix(items, "v", classes, keep=["id"]).count() == 11 * 9
    empty = N.nearest_class(items, "v", classes.limit(0)).collect()
    assert len(empty) == 11 and all(r["predicted_idx"] is None and r["sim"] is None for r in empty)
    assert N.class_softmax(items, "v", classes.limit(0), keep=["id"]).count() == 0


def test_large_class_side_has_the_same_schema_and_winners(spark):
    """10 cells and 5,000,000 cells: one schema, and the planted nearest class wins."""
    rng = np.random.default_rng(0)
    n, d = 78_125, 64
    base = rng.standard_normal((n, d))
    rows = spark.createDataFrame([(int(i), f"c{i}", [float(x) for x in base[i]]) for i in range(0, n, 125)], "class_idx int, class_label string, class_vec array<double>")
    # the others are derived from these inside Spark, so that the test need not ship five million numbers
    many = rows.select(F.explode(F.sequence(F.lit(0), F.lit(124))).alias("k"), "*").select(
        (F.col("class_idx") + F.col("k")).alias("class_idx"), F.concat("class_label", F.lit("+"), F.col("k").cast("string")).alias("class_label"),
        F.transform("class_vec", lambda x, i: F.when(i == F.col("k") % d, x + 3 * (F.col("k") + 1)).otherwise(x)).alias("class_vec"))
    assert many.count() * d == 5_000_000
    items = many.where("class_idx % 9973 = 5").select(F.col("class_idx").cast("string").alias("gt_idx"), F.col("class_vec").alias("v"), F.col("class_label").alias("gt"))
    big = N.zero_shot(items, "v", "gt", many)
    small = N.zero_shot(items, "v", "gt", many.limit(1))
    assert big.schema == small.schema
    got = big.collect()
    assert got and all(r["correct"] and abs(r["sim"] - 1) < 1e-9 for r in got)


def test_probability_is_that_of_the_softmax(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    cent = N.class_centroids(emb, "label", "embedding").select(
        F.col("label").alias("class_idx"), F.col("label").cast("string").alias("class_label"), "class_vec")
    items = emb.select("vec_id", "embedding", "label")
    for cells in (4_000_000, 64 * 3):
        monkeypatch.setattr(N, "MAX_CLASS_CELLS", cells)
        a = {r["vec_id"]: (r["predicted_idx"], round(r["prob"], 9)) for r in N.zero_shot(items, "embedding", "label", cent).collect()}
        w = N.class_softmax(items, "embedding", cent, keep=["vec_id"]).collect()
        best = {}
        for r in w:
            if r["vec_id"] not in best or r["prob"] > best[r["vec_id"]][1]:
                best[r["vec_id"]] = (r["class_idx"], round(r["prob"], 9))
        assert a == best

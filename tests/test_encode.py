"""Text vectors: plug-in dense encoder and the term-count route."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from scorecraft.operators import nearest as N
from scorecraft.operators.encode import encode_with, token_nearest


def test_plugin_encoder_nearest_class(spark):
    # Defined inside the test so that it is shipped to the Python workers by value.
    def hashing_encoder():
        """Deterministic stand-in for a neural text encoder: hashed character trigrams, 64 dims."""
        def enc(texts):
            out = np.zeros((len(texts), 64), dtype=np.float32)
            for i, t in enumerate(texts):
                t = t.lower()
                for j in range(max(len(t) - 2, 0)):
                    out[i, zlib.crc32(t[j:j + 3].encode()) % 64] += 1.0
            return out
        return enc

    classes = spark.createDataFrame([(0, "baroque"), (1, "cubism"), (2, "impressionism")],
                                    "class_idx int, class_label string")
    answers = spark.createDataFrame([(1, "It is Cubism."), (2, "baroque art"), (3, "impressionism, clearly")],
                                    "id int, text string").repartition(2)
    cvec = encode_with(classes.withColumn("text", F.col("class_label")), "text", "class_vec", hashing_encoder)
    avec = encode_with(answers, "text", "vec", hashing_encoder, batch_rows=2)
    got = {r["id"]: r["predicted_label"] for r in N.nearest_class(avec, "vec", cvec).collect()}
    assert got == {1: "cubism", 2: "baroque", 3: "impressionism"}


def test_token_nearest_ties_and_unmatched(spark):
    left = spark.createDataFrame([(1, "red blue"), (2, "nothing shared"), (3, "blue")], "k int, t string")
    right = spark.createDataFrame([(10, "red"), (11, "blue"), (12, "red blue blue")], "c int, t string")
    got = {r["k"]: (r["c"], round(r["cosine"], 6)) for r in
           token_nearest(left, "k", "t", right, "c", "t").collect()}
    # k=1: cos(red blue, red blue blue) = 3 / (sqrt2 * sqrt5) = 0.948683 beats 0.707107 for 10 and 11
    assert got[1] == (12, 0.948683)
    assert got[2] == (None, 0.0)
    # k=3: blue vs 11 -> 1.0
    assert got[3] == (11, 1.0)


def test_char_trigram_cosine_matches_python(spark):
    import math
    from collections import Counter
    from scorecraft.operators.encode import token_cosine
    left = [(1, "Claude Monet"), (2, "monet"), (3, "Pablo Picasso"), (4, "xy")]
    right = [(0, "claude monet"), (1, "pablo picasso"), (2, "édouard manet")]
    got = {(r["k"], r["c"]): round(r["cosine"], 9) for r in token_cosine(
        spark.createDataFrame(left, "k int, t string"), "k", "t",
        spark.createDataFrame(right, "c int, t string"), "c", "t", analyzer="char3").collect()}

    def grams(t):
        t = t.lower()
        return Counter(t[i:i + 3] for i in range(len(t) - 2))
    want = {}
    for k, a in left:
        for c, b in right:
            ga, gb = grams(a), grams(b)
            dot = sum(ga[g] * gb[g] for g in ga)
            if dot:
                want[(k, c)] = round(dot / (math.sqrt(sum(v * v for v in ga.values())) *
                                            math.sqrt(sum(v * v for v in gb.values()))), 9)
    assert got == want


def test_rows_without_terms_are_kept(spark):
    from scorecraft.operators.encode import token_nearest
    left = spark.createDataFrame([(1, "red"), (2, ""), (3, None), (4, "!!!")], "k int, t string")
    right = spark.createDataFrame([(10, "red"), (11, "")], "c int, t string")
    got = {r["k"]: (r["c"], r["cosine"]) for r in token_nearest(left, "k", "t", right, "c", "t").collect()}
    assert got == {1: (10, 1.0), 2: (None, 0.0), 3: (None, 0.0), 4: (None, 0.0)}


def test_shuffle_join_path_equals_broadcast_path(spark, monkeypatch):
    """Past the broadcast bound the class terms are shuffle-joined; results are unchanged."""
    from conftest import SF_SMALL
    from scorecraft.operators import encode
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    a = {(r["doc_id"], r["item_id"], round(r["cosine"], 9)) for r in
         encode.token_nearest(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    monkeypatch.setattr(encode, "MAX_CLASS_TERMS", 10)
    b_df = encode.token_nearest(docs, "doc_id", "text", bench, "item_id", "text")
    b = {(r["doc_id"], r["item_id"], round(r["cosine"], 9)) for r in b_df.collect()}
    assert a == b

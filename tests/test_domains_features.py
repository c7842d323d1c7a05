"""Domains, display labels, image-bytes source and feature-table classification."""

import pytest
from pyspark.sql import functions as F

from conftest import ANNOTATIONS, FIXTURES, SF_SMALL
from scorecraft.operators import domains as D
from scorecraft.operators import metrics as M
from scorecraft.operators.nearest import class_centroids
from scorecraft.plans.evaluate import classify_features
from scorecraft.sources.files import read_annotations, read_images


def test_ordered_domain_and_year_domain(spark):
    dom = D.ordered_domain(spark, "ArTest").orderBy("class_idx").collect()
    assert len(dom) == 25 and dom[0]["class"] == "early renaissance" and dom[-1]["class"] == "pop art"
    with pytest.raises(KeyError):
        D.ordered_domain(spark, "Unknown")
    years = [r["class"] for r in D.year_domain(spark, 100).orderBy("class_idx").collect()]
    assert years == ["1400", "1500", "1600", "1700", "1800", "1900", "2000"]
    assert D.year_domain(spark, 10).count() == 70


def test_display_labels_align_with_sorted_styles(spark):
    ann = read_annotations(spark, ANNOTATIONS)
    counts = M.pair_counts(ann.select(F.lit("r").alias("run"), F.lower("art_style").alias("gt"),
                                      F.lower("art_style").alias("pred")), ["run"])
    dom = M.label_domain(counts, ["run"], "gt")
    out = {r["class"]: r["display"] for r in M.display_labels(dom, ["run"], D.DISPLAY_LABELS["ArTest"]).collect()}
    assert len(out) == 25
    assert out["abstract expressionism"] == "Abstract Expression."
    assert out["post impressionism"] == "Post-Impression."
    assert out["ukiyo-e"] == "Ukiyo-E"


def test_class_prompts_require_placeholder(spark):
    dom = D.ordered_domain(spark, "JenAesthetics")
    rows = D.class_prompts(dom, "a [art_style] painting", "art_style").orderBy("class_idx").collect()
    assert rows[0]["class_prompt"] == "a renaissance painting"
    with pytest.raises(ValueError):
        D.class_prompts(dom, "a painting", "art_style")


def test_binary_source(spark):
    imgs = read_images(spark, f"{FIXTURES}/datasets", "*.csv")
    r = imgs.first()
    assert r["file"] == "ArTest.csv" and len(r["content"]) > 1000


def test_classify_stored_features(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    feats = emb.select(F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("file"),
                       F.col("embedding").alias("features"))
    ann = emb.select(F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("file"),
                     F.col("label").cast("string").alias("label"))
    classes = class_centroids(emb, "label", "embedding").select(
        F.col("label").alias("class_idx"), F.col("label").cast("string").alias("class_label"), "class_vec")
    out = classify_features(ann, feats, classes, "label")
    assert out.count() == emb.count()
    first_n = classify_features(ann, feats, classes, "label", n=10)
    assert first_n.count() == 10
    from scorecraft.operators.nearest import nearest_class
    direct = nearest_class(emb, "embedding", classes).where(F.col("predicted_idx") == F.col("label")).count()
    assert out.where("correct").count() == direct


def test_first_n_distributed_path_equals_top_k(spark):
    from scorecraft.operators.ordering import first_n
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "n_chars").repartition(5)
    want = [r["doc_id"] for r in docs.orderBy("doc_id").limit(137).collect()]
    got = sorted(r["doc_id"] for r in first_n(docs, "doc_id", 137, top_k_max=10).collect())
    assert got == want
    assert first_n(docs, "doc_id", -1).count() == docs.count()
    assert first_n(docs, "doc_id", 10 ** 9, top_k_max=10).count() == docs.count()


def test_image_requests_join_annotations_to_bytes(spark):
    import json
    from scorecraft.operators.prompts import image_requests
    imgs = read_images(spark, f"{FIXTURES}/datasets", "*.csv")
    ann = spark.createDataFrame([("ArTest.csv", "Which style?"), ("missing.jpg", "x")], "file string, q string")
    out = image_requests(ann, imgs, F.col("q")).collect()
    assert len(out) == 1 and out[0]["file"] == "ArTest.csv"
    req = json.loads(out[0]["request_json"])
    assert req["messages"][0]["content"][0]["text"] == "Which style?"
    assert req["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/jpeg;base64,")


def test_classify_features_is_alike_at_every_block_size(spark, monkeypatch):
    from scorecraft.operators import nearest as N
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    file = F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".jpg"))
    feats = emb.select(file.alias("file"), F.col("embedding").alias("features"))
    ann = emb.select(file.alias("file"), F.col("label").cast("string").alias("label"))
    classes = class_centroids(emb, "label", "embedding").select(
        F.col("label").alias("class_idx"), F.col("label").cast("string").alias("class_label"), "class_vec")
    one = classify_features(ann, feats, classes, "label")
    a = {r["file"]: (r["predicted_idx"], r["correct"], round(r["prob"], 9)) for r in one.collect()}
    monkeypatch.setattr(N, "MAX_CLASS_CELLS", 64 * 3)
    many = classify_features(ann, feats, classes, "label")
    assert many.schema == one.schema
    assert a == {r["file"]: (r["predicted_idx"], r["correct"], round(r["prob"], 9)) for r in many.collect()}

"""Readers and writers: run identity, manifests, partitioned sinks, request batches."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import RESULTS
from scorecraft.sources import sinks
from scorecraft.sources.files import read_manifests, read_predictions


def test_run_identity_parses_all_folders(spark):
    man = read_manifests(spark, f"{RESULTS}/*/args.json")
    rows = man.select("run", "dataset", "attribute_raw", "attribute", "given_author", "given_year", "model").collect()
    assert len(rows) == 39
    by = {r["run"]: r for r in rows}
    r = by["ArTest_styleGivenAuthorAndYear_LLaVa"]
    assert (r["dataset"], r["attribute_raw"], r["attribute"], r["given_author"], r["given_year"], r["model"]) == \
        ("ArTest", "style", "art_style", True, True, "LLaVA")
    assert by["WikiArt_style_GPT-4o"]["model"] == "GPT-4o"
    assert {x["model"] for x in rows} == {"CLIP", "LLaVA", "OpenFlamingo", "GPT-4o"}


def test_multiline_answers_survive(spark):
    raw = read_predictions(spark, f"{RESULTS}/ArTest_year_LLaVa/results.csv")
    assert raw.count() == 147
    assert raw.where(F.col("preds").contains("\n")).count() > 0
    assert raw.agg(F.min("row_idx"), F.max("row_idx")).first() == (0, 146)


def test_partitioned_sink_and_manifest(spark):
    out = tempfile.mkdtemp(prefix="scorecraft-sink-")
    raw = read_predictions(spark, f"{RESULTS}/*/results.csv").select("dataset", "attribute", "model", "row_idx", "gt")
    sinks.write_runs(raw, f"{out}/runs")
    back = spark.read.parquet(f"{out}/runs")
    one = back.where((F.col("model") == "CLIP") & (F.col("attribute") == "author"))
    assert one.count() == 147
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "model" in filters and "attribute" in filters
    # re-writing one run replaces only that partition (dynamic overwrite)
    part = raw.where(F.col("model") == "CLIP").orderBy("attribute", "row_idx").limit(10).cache()
    k = part.select("dataset", "attribute", "model").distinct().count()
    sinks.write_runs(part, f"{out}/runs")
    assert spark.read.parquet(f"{out}/runs").count() == 147 * 5 - 147 * k + 10
    sinks.append_manifest(spark, {"dataset_name": "ArTest", "attribute": "style", "n": -1}, f"{out}/manifests")
    m = spark.read.parquet(f"{out}/manifests").first()
    assert json.loads(m["args_json"])["n"] == -1


def test_request_sink_writes_json_lines(spark):
    from scorecraft.operators.prompts import request_batch
    out = tempfile.mkdtemp(prefix="scorecraft-req-")
    df = spark.createDataFrame([(1, "hello", b"\x00\x01")], "id int, prompt string, payload binary")
    sinks.write_requests(request_batch(df, F.col("prompt"), F.col("payload"), ["id"]), f"{out}/req")
    lines = [l for f in os.listdir(f"{out}/req") if f.startswith("part-")
             for l in open(f"{out}/req/{f}").read().splitlines()]
    req = json.loads(lines[0])
    assert req["model"] == "gpt-4o" and req["max_tokens"] == 300
    assert req["messages"][0]["content"][1]["image_url"]["url"] == "data:image/jpeg;base64,AAE="


def test_feature_sink_names_files(spark):
    from conftest import SF_SMALL
    out = tempfile.mkdtemp(prefix="scorecraft-feat-")
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.concat(F.lit("Outliers_images/img_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("file"),
        F.col("embedding").alias("features"))
    sinks.write_features(emb, f"{out}/features")
    back = spark.read.parquet(f"{out}/features")
    assert back.count() == emb.count()
    r = back.where(F.col("file") == "Outliers_images/img_7.jpg").first()
    assert r["feature_file"] == "img_7.pt" and len(r["features"]) == 64


def test_processed_files_win_per_run(spark):
    from scorecraft.sources.files import preferred_results, read_processed
    raw = read_predictions(spark, f"{RESULTS}/*/results.csv")
    proc = read_processed(spark, f"{RESULTS}/*/results_processed.csv")
    both = preferred_results(raw, proc)
    by = {r["run"]: (r["source"], r["count"]) for r in both.groupBy("run", "source").count().collect()}
    assert by["ArTest_author_LLaVa"] == ("processed", 147)
    assert by["ArTest_style_CLIP"] == ("raw", 147)
    assert len(by) == 5
    none = preferred_results(raw, proc.limit(0))
    assert none.where(F.col("source") == "raw").count() == 5 * 147


def test_conditioned_run_does_not_replace_its_base_run(spark, tmp_path):
    from scorecraft.sources.sinks import write_runs
    base = [("ArTest", "art_style", "LLaVA", "ArTest_style_LLaVa", i) for i in range(5)]
    given = [("ArTest", "art_style", "LLaVA", "ArTest_styleGivenAuthor_LLaVa", i) for i in range(3)]
    schema = "dataset string, attribute string, model string, run string, row_idx long"
    out = str(tmp_path / "runs")
    for part in (base, given, given):
        write_runs(spark.createDataFrame(part, schema), out)
    got = {r["run"]: r["count"] for r in spark.read.parquet(out).groupBy("run").count().collect()}
    assert got == {"ArTest_style_LLaVa": 5, "ArTest_styleGivenAuthor_LLaVa": 3}


def test_manifests_have_one_row_a_run_and_one_schema(spark):
    out = tempfile.mkdtemp(prefix="scorecraft-man-")
    one = {"dataset_name": "ArTest", "attribute": "style", "image_model": "CLIP", "n": -1, "own_flag": True}
    for _ in range(3):  # retried writes
        sinks.append_manifest(spark, one, out)
    sinks.append_manifest(spark, {"dataset_name": "ArTest", "attribute": "year", "image_model": "LLaVa", "lr": 0.5, "n": "not a number"}, out)
    sinks.append_manifest(spark, {}, out, run="bare")
    back = spark.read.parquet(out)
    assert {r["run"]: (r["attribute"], r["n"], r["lr"]) for r in back.collect()} == {
        "ArTest_style_CLIP": ("style", -1, None), "ArTest_year_LLaVa": ("year", None, 0.5), "bare": (None, None, None)}
    assert back.count() == 3 and json.loads(back.where("run = 'ArTest_style_CLIP'").first()["args_json"]) == one
    sinks.append_manifest(spark, {**one, "n": 5}, out)
    assert spark.read.parquet(out).where("run = 'ArTest_style_CLIP'").first()["n"] == 5

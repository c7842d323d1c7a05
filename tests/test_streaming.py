"""Incremental scoring over the committed prediction files equals the batch result."""

import tempfile


from conftest import RESULTS
from scorecraft.operators import metrics as M
from scorecraft.functions.text import report_key_lower
from scorecraft.plans.evaluate import load_runs
from scorecraft.streaming.incremental import start_scoring


def test_stream_matches_batch(spark):
    out = tempfile.mkdtemp(prefix="scorecraft-stream-")
    ckpt = tempfile.mkdtemp(prefix="scorecraft-stream-ckpt-")
    q = start_scoring(spark, RESULTS, out, name="t_scores", checkpoint_location=ckpt)
    q.awaitTermination(300)
    got = {r["run"]: (r["n"], r["correct"]) for r in spark.read.parquet(out).collect()}
    raw, _, _ = load_runs(spark, RESULTS)
    counts = M.pair_counts(raw.select("run", report_key_lower("gt").alias("gt"),
                                      report_key_lower("preds").alias("pred")), ["run"])
    want = {r["run"]: (r["n"], r["correct"]) for r in M.accuracy(counts, ["run"]).collect()}
    assert got == want
    assert got["ArTest_style_CLIP"] == (147, 54)
    # A restart on the same checkpoint resumes: nothing is counted twice.
    q2 = start_scoring(spark, RESULTS, out, name="t_scores", checkpoint_location=ckpt)
    q2.awaitTermination(300)
    assert {r["run"]: (r["n"], r["correct"]) for r in spark.read.parquet(out).collect()} == want

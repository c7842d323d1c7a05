"""Golden tests on the committed prediction files (numbers derived from them)."""

import pytest
from pyspark.sql import functions as F

from conftest import ANNOTATIONS, RESULTS
from scorecraft.functions import text as T
from scorecraft.operators import metrics as M
from scorecraft.plans.evaluate import evaluate_predictions, load_runs
from scorecraft.sources.files import preferred_results, read_annotations


@pytest.fixture(scope="module")
def runs(spark):
    return load_runs(spark, RESULTS)


def test_ingest_shapes(runs):
    raw, proc, man = runs
    assert raw.count() == 5 * 147          # multi-line answers: 147 records per file
    assert proc.count() == 147
    assert man.count() == 39
    assert raw.where(F.col("preds").contains("\n")).count() > 0


def test_accuracy_and_macro(spark, runs):
    raw, proc, _ = runs
    pref = preferred_results(raw, proc)
    f = pref.select("run", T.report_key_lower("gt").alias("gt"), T.report_key_lower("pred").alias("pred"))
    counts = M.pair_counts(f, ["run"])
    acc = {r["run"]: (r["correct"], round(r["accuracy"], 2)) for r in M.accuracy(counts, ["run"]).collect()}
    assert acc["ArTest_style_CLIP"] == (54, 36.73)
    assert acc["ArTest_author_CLIP"] == (93, 63.27)
    assert acc["ArTest_author_LLaVa"] == (36, 24.49)
    mac = {r["run"]: r for r in M.macro_average(M.precision_recall_f1(M.class_stats(counts, ["run"])),
                                                ["run"]).collect()}
    for run, (n, p, r, f1) in {"ArTest_style_CLIP": (25, 0.3453, 0.4200, 0.3460),
                               "ArTest_author_CLIP": (95, 0.6891, 0.8383, 0.7248),
                               "ArTest_author_LLaVa": (95, 0.1190, 0.1934, 0.1315)}.items():
        m = mac[run]
        assert m["n_classes"] == n
        assert (round(m["macro_precision"], 4), round(m["macro_recall"], 4), round(m["macro_f1"], 4)) == (p, r, f1)


def test_year_buckets_clip(runs):
    raw, _, _ = runs
    y = raw.where(F.col("run") == "ArTest_year_CLIP")
    got = [y.where(T.year_bucket("preds", p) == T.year_bucket("gt", p)).count() for p in (100, 10, 1)]
    assert got == [104, 31, 9]


def test_year_llava_regex_route(runs):
    raw, _, _ = runs
    y = raw.where(F.col("run") == "ArTest_year_LLaVa")
    got = []
    for p in (100, 10):
        ev = evaluate_predictions(y, year_precision=p)
        got.append(ev.where("correct").count())
    assert got == [95, 18]


def test_golden_pair_author_llava(runs):
    raw, proc, _ = runs
    r = raw.where(F.col("run") == "ArTest_author_LLaVa")
    ev = evaluate_predictions(r)
    ref = proc.select("run", "row_idx", F.col("predicted_class").alias("ref"))
    j = ev.join(ref, ["run", "row_idx"])
    exact = F.lower("pred_clean") == F.col("ref")
    same = F.col("predicted_class") == F.col("ref")
    s = j.agg(F.sum(exact.cast("int")).alias("exact"), F.sum((exact & same).cast("int")).alias("both"),
              F.sum(same.cast("int")).alias("same")).first()
    assert s["exact"] == 125 and s["both"] == 125
    assert s["same"] >= 130


def test_audits(spark, runs):
    raw, _, man = runs
    ann = read_annotations(spark, ANNOTATIONS)
    assert ann.count() == 147
    style = raw.where(F.col("run") == "ArTest_style_CLIP")
    # AU1: one file name drifts between the annotation table and the results
    assert style.join(ann, style["images"] == ann["file"], "left_anti").count() == 1
    # AU4: manifest attribute contradicts the folder after aliasing
    from scorecraft.operators import audit as A
    assert A.manifest_attribute_drift(man).count() == 2
    # AU3: manifests without results (39 manifests, 5 result files)
    assert A.runs_without_results(man, raw).count() == 34
    # AU1 through the library function
    assert A.unmatched_files(style, ann).count() == 2


def test_end_to_end_all_runs_in_one_job(runs):
    """Raw answers of five runs -> one evaluation job -> the reference's accuracies."""
    from scorecraft.plans.evaluate import attach_manifest, run_report
    raw, _, man = runs
    ev = evaluate_predictions(attach_manifest(raw, man).drop("manifest_attribute"))
    acc = {r["run"]: r["correct"] for r in run_report(ev)["accuracy"].collect()}
    assert acc == {"ArTest_author_CLIP": 93, "ArTest_author_LLaVa": 36, "ArTest_style_CLIP": 54,
                   "ArTest_year_CLIP": 104, "ArTest_year_LLaVa": 95}


def test_model_report_for_style(runs):
    from scorecraft.operators.domains import DISPLAY_LABELS
    from scorecraft.plans.evaluate import model_report
    raw, proc, _ = runs
    rep = model_report(raw, proc, "ArTest", "art_style", key="underscore", display=DISPLAY_LABELS["ArTest"])
    acc = rep["accuracy"].collect()
    assert [(r["model"], r["correct"], r["n"]) for r in acc] == [("CLIP", 54, 147)]
    labels = rep["labels"].orderBy("class_idx").collect()
    assert len(labels) == 25 and labels[0]["display"] == "Abstract Expression."
    assert rep["confusion"].count() == 25 * 25
    assert sum(r["n"] for r in rep["confusion"].where("true_label = pred_label").collect()) == 54


def test_profiles_from_manifests_and_stream_cleaning(spark, runs):
    from scorecraft.plans.evaluate import run_profiles_from_manifests
    from scorecraft.streaming.incremental import running_counts
    raw, proc, man = runs
    prof = run_profiles_from_manifests(man)
    assert "LLaVA|author|false|false" in prof and "OpenFlamingo|year|false|false" in prof
    r = raw.where(F.col("run") == "ArTest_author_LLaVa")
    ev = evaluate_predictions(r, profiles=prof)
    assert ev.where(F.lower("pred_clean") == F.lower(F.col("gt"))).count() > 0
    # The streaming count table with cleaning applies the same rules as the batch job.
    counts = running_counts(r, clean=True, profiles=prof)
    hits = counts.where(F.col("pred") == F.col("gt")).agg(F.sum("n")).first()[0]
    assert hits == ev.where(F.lower("pred_clean") == F.col("gt")).count()


def test_gt_disagreements_year_clip(spark, runs):
    """AU2: four rows of the year run store a ground truth that differs from the annotation."""
    from scorecraft.operators import audit as A
    raw, _, _ = runs
    ann = read_annotations(spark, ANNOTATIONS)
    d = A.gt_disagreements(raw.where(F.col("run") == "ArTest_year_CLIP"), ann, "year")
    assert sorted((r["gt"], r["annotated"]) for r in d.collect()) == \
        [("1947", "1964"), ("1956", "1962"), ("1962", "1947"), ("1964", "1956")]
    assert A.gt_disagreements(raw.where(F.col("run") == "ArTest_style_CLIP"), ann, "art_style").count() == 0


def test_evaluate_options(spark, runs):
    """Checkpointed cleaning gives the same rows; the nearest-class year route stays in the domain."""
    raw, _, _ = runs
    r = raw.where(F.col("run") == "ArTest_author_LLaVa")
    a = {(x["row_idx"], x["predicted_class"]) for x in evaluate_predictions(r).collect()}
    b = {(x["row_idx"], x["predicted_class"]) for x in evaluate_predictions(r, checkpoint=True).collect()}
    assert a == b
    y = raw.where(F.col("run") == "ArTest_year_LLaVa")
    ev = evaluate_predictions(y, year_route="nearest")
    classes = {x["predicted_class"] for x in ev.collect()}
    assert classes <= {str(v) for v in range(1400, 2100, 100)}
    assert ev.count() == 147


def test_year_out_of_domain_flag(runs):
    raw, _, _ = runs
    ev = evaluate_predictions(raw.where(F.col("run") == "ArTest_year_CLIP"))
    # One painting (1305) lies before the first year class.
    assert ev.where("out_of_domain").count() == 1


def test_manifest_class_prompts(spark, runs):
    """PRM3 with each run's own prompt: '[author]' -> class; a prompt without it is refused."""
    import pytest
    raw, _, _ = runs
    r = raw.where(F.col("run") == "ArTest_author_LLaVa")
    with_ph = r.withColumn("prompt", F.lit("the painting is by [author]"))
    ev = evaluate_predictions(with_ph, class_template="manifest")
    # Class texts share the prompt words, so exact answers still find their class.
    hits = ev.where(F.lower("pred_clean") == F.col("predicted_class")).count()
    assert hits >= 120
    without = r.withColumn("prompt", F.lit("Who is the author of this painting?"))
    with pytest.raises(Exception):
        evaluate_predictions(without, class_template="manifest").collect()

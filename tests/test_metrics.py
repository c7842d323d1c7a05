"""Metric operators against plain-Python counting on random label lists."""

import random
from collections import Counter


from scorecraft.operators import metrics as M


def _py_prf(gt, pred):
    labels = sorted(set(g for g in gt if g is not None))
    out = {}
    for c in labels:
        tp = sum(1 for g, p in zip(gt, pred) if g == c and p == c)
        sup = sum(1 for g in gt if g == c)
        prd = sum(1 for p in pred if p == c)
        prec = tp / prd if prd else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out[c] = (sup, prd, tp, prec, rec, f1)
    return labels, out


def test_random_against_python(spark):
    rnd = random.Random(7)
    gt = [rnd.choice(["a", "b", "c", "d", None]) for _ in range(400)]
    pred = [rnd.choice(["a", "b", "c", "x", None]) for _ in range(400)]
    df = spark.createDataFrame(list(zip(["r"] * 400, gt, pred)), "run string, gt string, pred string")
    counts = M.pair_counts(df, ["run"])
    acc = M.accuracy(counts, ["run"]).first()
    assert acc["correct"] == sum(1 for g, p in zip(gt, pred) if g is not None and g == p)
    assert acc["n"] == 400
    labels, want = _py_prf(gt, pred)
    got = {r["class"]: r for r in M.precision_recall_f1(M.class_stats(counts, ["run"])).collect()}
    assert sorted(got) == labels
    for c in labels:
        r = got[c]
        sup, prd, tp, p, rc, f1 = want[c]
        assert (r["support"], r["predicted"], r["tp"]) == (sup, prd, tp)
        assert abs(r["precision"] - p) < 1e-12 and abs(r["recall"] - rc) < 1e-12 and abs(r["f1"] - f1) < 1e-12
    conf = M.confusion_long(counts, ["run"]).collect()
    assert len(conf) == len(labels) ** 2
    pairs = Counter((g, p) for g, p in zip(gt, pred) if g in labels and p in labels)
    for r in conf:
        assert r["n"] == pairs.get((r["true_label"], r["pred_label"]), 0)


def test_independent_domains_and_wide(spark):
    df = spark.createDataFrame([("r", "a", "a"), ("r", "a", "x"), ("r", "b", "a")], "run string, gt string, pred string")
    counts = M.pair_counts(df, ["run"])
    sub = M.confusion_long(counts, ["run"], M.independent_domains(counts, ["run"]))
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in sub.collect()}
    assert cells == {("a", "a"): 1, ("a", "x"): 1, ("b", "a"): 1, ("b", "x"): 0}
    wide = M.confusion_wide(M.confusion_long(counts, ["run"]), ["run"], ["a", "b"]).orderBy("true_idx").collect()
    assert [(r["true_label"], r["a"], r["b"]) for r in wide] == [("a", 1, 0), ("b", 1, 0)]


def test_display_labels_size_mismatch_raises(spark):
    import pytest
    dom = spark.createDataFrame([("r", ["a", "b"])], "run string, labels array<string>")
    assert [r["display"] for r in M.display_labels(dom, ["run"], ["A", "B"]).orderBy("class_idx").collect()] == \
        ["A", "B"]
    with pytest.raises(Exception):
        M.display_labels(dom, ["run"], ["A"]).collect()


def test_confusion_rows_equal_long_form(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["r1", "r2"]), rnd.choice("abcd"), rnd.choice("abcx")) for _ in range(300)]
    df = spark.createDataFrame(rows, "run string, gt string, pred string")
    counts = M.pair_counts(df, ["run"])
    long = {(r["run"], r["true_label"], r["pred_label"]): r["n"] for r in M.confusion_long(counts, ["run"]).collect()}
    wide = {}
    for r in M.confusion_rows(counts, ["run"]).collect():
        for p, n in zip(r["pred_labels"], r["counts"]):
            wide[(r["run"], r["true_label"], p)] = n
    assert wide == long


def test_accuracy_over_all_annotations(spark):
    """AGG2: hits over the scored rows divided by all annotated rows of the run."""
    df = spark.createDataFrame([("r", "a", "a"), ("r", "b", "a"), ("r", "c", "c")], "run string, gt string, pred string")
    den = spark.createDataFrame([("r", 6)], "run string, n_total int")
    row = M.accuracy_over(M.pair_counts(df, ["run"]), ["run"], den).first()
    assert (row["correct"], row["n"], row["n_total"]) == (2, 3, 6)
    assert abs(row["accuracy"] - 200 / 3) < 1e-9 and abs(row["accuracy_all"] - 100 / 3) < 1e-9


def test_reports_without_run_columns(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "gt string, pred string")
    counts = M.pair_counts(df, [])
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in M.confusion_long(counts, []).collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 1 and cells[("c", "c")] == 0
    acc = M.accuracy(counts, []).first()
    assert (acc["n"], acc["correct"]) == (4, 2)
    rows = {r["true_label"]: r["counts"] for r in M.confusion_rows(counts, []).collect()}
    assert rows == {"a": [1, 1, 0], "b": [0, 1, 0], "c": [0, 0, 0]}


def test_dense_confusion_has_no_label_cap(spark):
    df = spark.range(5001).selectExpr("cast(id as string) gt", "cast(id as string) pred")
    counts = M.pair_counts(df, [])
    dense = M.confusion_long(counts, [])
    assert dense.where("true_label = '17'").agg({"n": "sum", "*": "count"}).first().asDict() == {"sum(n)": 1, "count(1)": 5001}


def test_confusion_over_the_class_list_adds_up(spark):
    rows = [("r", "a", "a"), ("r", "a", "unknown"), ("r", "b", None), ("r", "odd", "a"), ("r", None, "odd"), ("r", "a", "odd"), ("s", "x", "x")]
    counts = M.pair_counts(spark.createDataFrame(rows, "run string, gt string, pred string"), ["run"])
    classes = spark.createDataFrame([("r", 0, "b"), ("r", 1, "a"), ("r", 2, "unknown"), ("s", 0, "x"), ("t", 0, "y")], "run string, class_idx int, class string")
    got = {(r["run"], r["true_label"], r["pred_label"]): (r["true_idx"], r["pred_idx"], r["n"]) for r in M.confusion_over(counts, ["run"], classes).collect()}
    assert {k: v for k, v in got.items() if v[2]} == {
        ("r", "a", "a"): (1, 1, 1), ("r", "a", "unknown"): (1, 2, 1), ("r", "b", None): (0, None, 1), ("r", None, "a"): (None, 1, 1),
        ("r", None, None): (None, None, 1), ("r", "a", None): (1, None, 1), ("s", "x", "x"): (0, 0, 1)}
    assert sum(v[2] for k, v in got.items() if k[0] == "r") == 6 and sum(1 for k in got if k[0] == "r") == 9 + 4 and ("t", "y", "y") in got

"""Splittable reader of quoted CSV files against Spark's whole-file reader and Python's csv module."""

import csv
import os
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import ANNOTATIONS, RESULTS
from scorecraft.sources import files, records


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes: nearly every quoted line break lies across two."""
    keys = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def _whole(spark, path, schema):
    opts = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return sorted((tuple(r) for r in spark.read.options(**opts).schema(schema).csv(path).collect()), key=repr)


def test_one_file_in_many_tasks_equals_the_whole_file_reader(spark, small_ranges):
    r = random.Random(1)
    folder = tempfile.mkdtemp(prefix="scorecraft-csv-")
    path = os.path.join(folder, "a.csv")
    words = ["plain", 'say "hi"', "two\nlines", "a,b", "", "ü\n\n,\"x\"\n", 'end"', "\n", "long " * 30]
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["i", "a", "b"])
        for i in range(200):
            w.writerow([i, r.choice(words), r.choice(words) + str(r.randint(0, 9))])
    schema = "i bigint, a string, b string"
    rows, rejects = files.read_rows(spark, path, schema, ("i",))
    assert rows.rdd.getNumPartitions() > 50 or records._lines(spark, path).select(F.spark_partition_id().alias("p")).distinct().count() > 50
    got = rows.collect()
    assert sorted((tuple(x)[2:] for x in got), key=repr) == _whole(spark, path, schema)
    assert all(x["pos"] == x["i"] for x in got) and len(got) == 200
    assert rejects.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='a",\n x', max_size=12), min_size=1, max_size=12), st.integers(0, 1))
def test_states_of_lines_follow_the_quotes(fields, start):
    """A file of quoted fields: the state before a line tells whether its first character is inside one."""
    import pyarrow as pa
    text = "\n".join(",".join('"' + f.replace('"', '""') + '"' for f in fields[k:k + 3]) for k in range(0, len(fields), 3))
    inside, expect = False, []
    at_start = True
    i = 0
    for line in text.split("\n"):
        expect.append(int(inside))
        i = 0
        at_start = not inside
        while i < len(line):
            c = line[i]
            if inside:
                if line[i:i + 2] == '""':
                    i += 2
                    continue
                if c == '"':
                    inside, at_start = False, False
            elif c == '"' and at_start:
                inside = True
            elif c == ",":
                at_start = True
            i += 1
    before, _ = records.states(pa.array(text.split("\n")), records.OUT)
    assert before.tolist() == expect


def test_quotes_inside_bare_fields_and_carriage_returns(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="scorecraft-csv-")
    path = _write(folder, "a.csv", 'i,a,b\r\n0,5" disk,x\r\n\r\n1,"two\r\nlines",y\r\n2,it\'s "so",z\n\n3,"a ""q"" b\n\nc","w"')
    rows, _ = files.read_rows(spark, path, "i bigint, a string, b string")
    got = {r["i"]: (r["pos"], r["a"], r["b"]) for r in rows.collect()}
    assert got == {0: (0, '5" disk', "x"), 1: (1, "two\r\nlines", "y"), 2: (2, 'it\'s "so"', "z"), 3: (3, 'a "q" b\n\nc', "w")}


def test_unclosed_quote_empty_file_and_header_alone(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="scorecraft-csv-")
    path = _write(folder, "a.csv", 'i,a\n0,x\n1,"never closed\nand on\n2,y' + "\n" * 60)
    rec = records.read_records(spark, path).orderBy("pos").collect()
    assert [r["pos"] for r in rec] == [0, 1, 2] and rec[2]["record"].startswith('1,"never closed\nand on\n2,y')
    for text in ("", "i,a\n", "i,a"):
        rows, rejects = files.read_rows(spark, _write(folder, "b.csv", text), "i bigint, a string")
        assert rows.count() == 0 and rejects.count() == 0


def test_rejects_keep_file_and_place(spark, small_ranges):
    folder = tempfile.mkdtemp(prefix="scorecraft-csv-") + "/ArTest_author_LLaVa"
    os.makedirs(folder)
    path = _write(folder, "results.csv", ',images,gt,preds\n0,a.jpg,x,"ok\nyes"\nnot a number,b.jpg,x,y\n2,c.jpg,x,y,too,many\n,d.jpg,x,y\n4,,x,y\n5,e.jpg,x,\n')
    good = files.read_predictions(spark, path)
    assert sorted((r["row_idx"], r["images"], r["preds"], r["pos"], r["model"]) for r in good.collect()) == [
        (0, "a.jpg", "ok\nyes", 0, "LLaVA"), (5, "e.jpg", None, 5, "LLaVA")]
    bad = files.rejected_rows(spark, path).orderBy("pos").collect()
    assert [(r["pos"], r["record"], r["run"]) for r in bad] == [
        (1, "not a number,b.jpg,x,y", "ArTest_author_LLaVa"), (2, "2,c.jpg,x,y,too,many", "ArTest_author_LLaVa"),
        (3, ",d.jpg,x,y", "ArTest_author_LLaVa"), (4, "4,,x,y", "ArTest_author_LLaVa")]


def test_committed_files_read_alike_in_small_ranges(spark, small_ranges):
    for name in ("ArTest_year_LLaVa", "ArTest_author_LLaVa", "ArTest_style_CLIP"):
        path = f"{RESULTS}/{name}/results.csv"
        got = files.read_predictions(spark, path).select("row_idx", "images", "gt", "preds")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == _whole(spark, path, files.PREDICTION_SCHEMA)
    ann = files.read_annotations(spark, ANNOTATIONS)
    with open(ANNOTATIONS, newline="", encoding="utf-8") as f:
        want = [r["file"] for r in csv.DictReader(f)]
    assert [r["file"] for r in ann.orderBy("pos").select("file").collect()] == want

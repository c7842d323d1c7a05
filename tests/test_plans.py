"""Physical-plan properties that matter at scale (checked on the smallest tables)."""

import pytest

from conftest import SF_SMALL
import __spark_entry__ as E


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()          # final (adaptive) plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_products(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_projection_reaches_the_scan(spark):
    plan = _plan(E.queries()["accuracy_by_run"](spark, SF_SMALL))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<l_partkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>"


def test_text_vectors_shuffles_no_documents(spark):
    plan = _plan(E.queries()["text_vectors"](spark, SF_SMALL))
    assert not [l for l in plan.split("\n") if "Exchange hashpartitioning(doc_id" in l]
    assert "ArrowEvalPython" in plan
    assert "SortMergeJoin" not in plan


def _ancestors(lines: list[str], i: int) -> list[str]:
    """Plan-tree ancestors of line ``i`` (lines with a smaller indentation above it)."""
    def indent(line: str) -> int:
        return len(line) - len(line.lstrip(" :+-|"))
    out, level = [], indent(lines[i])
    for line in reversed(lines[:i]):
        if line.strip() and indent(line) < level:
            out.append(line)
            level = indent(line)
    return out


def test_nearest_class_scores_without_shuffling_items(spark):
    df = E.queries()["nearest_class"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [i for i, l in enumerate(lines) if "FileScan parquet [vec_id" in l]
    assert scans
    for i in scans:   # the item scan's path to the root holds no exchange
        assert not any("Exchange" in a for a in _ancestors(lines, i))
    assert any("ArrowEvalPython" in l for l in lines)   # one projection; only the vector column crosses


def test_metrics_reuse_one_count_table(spark):
    plan = _plan(E.queries()["model_comparison"](spark, SF_SMALL))
    assert "InMemoryTableScan" in plan

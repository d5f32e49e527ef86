"""Plan-shape rules applied to every registered query's physical plan."""

import re

# Queries that fit models while being built return a fitted model's output; their
# operators are covered in test_operators.py.
MODEL_QUERIES = {"oof_probabilities", "model_comparison", "gap_model_ranking", "vector_clusters",
                 "model_selection", "oof_checks", "importance_table"}


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def assert_plan_shape(name: str, df) -> None:
    """No cartesian / nested-loop joins, no row-at-a-time Python UDFs, no window without
    a partition key, and Parquet scans that read a pruned column list."""
    plan = physical_plan(df)
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name
    assert "BatchEvalPython" not in plan, name
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\], \[", line), (name, line.strip())
    for m in re.finditer(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan):
        cols = [c for c in m.group(1).split(",") if c.strip()]
        assert len(cols) <= 8, (name, m.group(0)[:200])

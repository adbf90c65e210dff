"""Plan checks over every registered query that has an exact oracle (the reports, audits, changes, K1, K3)."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
# global_rank computes offsets over a table with one row per partition (bounded by the partition count).
BOUNDED_SINGLE_PARTITION = {"sync_users", "global_numbers"}
# Change requests number their accepted rows with global_rank; streams return the table that the run has written.
BOUNDED_SINGLE_PARTITION |= {n for n in oracle_sql() if n.startswith(("open_accounts", "register_customers", "apply_employees",
                                                                     "apply_promotions"))}

# The fixture's only administrator is a literal row, so the key of its semi-join with the users folds to a constant.
LITERAL_KEY = {"statements_for"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_plan_shape(spark, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in LITERAL_KEY:
        assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no scalar Python UDFs
    if name not in BOUNDED_SINGLE_PARTITION:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                # Allowed only for the final step of a global aggregate: one partial row per partition.
                below = lines[i + 1] if i + 1 < len(lines) else ""
                assert "HashAggregate(keys=[]" in below and "partial_" in below, plan

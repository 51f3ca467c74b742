"""What Catalyst makes of the plans."""

import pytest

from ledgerloom.plans import registry


def plan(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"whole_run", "fixpoint_fill"}))
def test_nothing_pairs_all_with_all(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    if name not in ("header_map", "header_rows"):  # a fixed list of aliases
        assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "page_range_scan")
    assert "GreaterThanOrEqual(turn,1)" in text and "LessThanOrEqual(turn,3)" in text and "text:string" not in text
    assert "l_shipdate" not in plan(spark, sf_dir, "component_math_status")

"""Plan shape and contract checks."""

import pytest

SF = "/root/testdata/sf0.001"
NO_PAIRS = ("rent_comps_topk", "nearest_by_category", "crosswalk_as_of", "market_definition_interval", "name_variation", "lead_lag", "fallback_recommendation", "target_panel", "forecast", "cross_source", "company_bias", "market_holdout", "stability")


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_nested_loop_joins(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["observation_filter_topn"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "l_comment" not in plan


def test_entry_and_oracles_name_the_same_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(5).count() == 5

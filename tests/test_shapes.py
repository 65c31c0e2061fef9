"""What the planner makes of the operators: pruned scans, pushed filters, no products, no tasks that see all rows."""

import re

import pytest
from loomhouse.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filtering_source"](spark, DATA))
    assert "GreaterThan(l_discount,0.05)" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_discount:double>", text)


def test_joins_read_what_they_need(spark):
    text = plan(QUERIES["hash_join"](spark, DATA))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in text
    assert "SortMergeJoin" in plan(QUERIES["merge_join"](spark, DATA))


@pytest.mark.parametrize("name", ["star_revenue", "dim_ensure_keys", "dim_lookup_default", "type1_scd", "scd2_scdensure", "scd2_asof_both", "snowflake_fullrow", "fact_ensure", "acc_snapshot", "agg_step_punctuation", "agg_step_sum_avg", "scd2_lookuprowasof", "dim_lookuprow"])
def test_no_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not any(word in text for word in ("NestedLoop", "Cartesian", "SinglePartition", "Python", "Arrow"))


def test_first_rows_are_combined_before_the_shuffle(spark):
    """A hot business key is one row for each task: the aggregate stands below the exchange too."""
    from loomhouse.operators.matching import extreme

    rows = spark.createDataFrame([(1, 2, "a")], "k int, n int, v string")
    text = plan(extreme(rows, ["k"], ["n"]))
    assert re.search(r"partial_min_by", text)


def test_rows_without_a_key_are_windowed_range_by_range(spark):
    """No window over all rows: only the sums of the ranges, a row each, meet in one task."""
    text = plan(QUERIES["agg_step_sum_avg"](spark, DATA))
    windows = re.findall(r"Window \[.*", text)
    assert windows and all("_range" in w for w in windows)


def test_versions_are_never_gathered_in_arrays(spark):
    assert "collect_list" not in plan(QUERIES["scd2_asof_both"](spark, DATA))

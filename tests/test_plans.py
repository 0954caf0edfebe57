"""Plans of the registered queries: no pairs without a key, no row-at-a-time Python, pruned scans."""

import re

import pytest

from chronoloom import catalogue

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plans_have_keys_and_no_slow_python(spark, name):
    said = plan(catalogue.QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", said)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("motion_profile", {"user_id"}), ("cluster_cuts", {"ts", "event_type"}), ("run_id", {"p_partkey", "p_size"}), ("word_count", {"conv_id", "text"}), ("lru_trim", {"o_orderkey", "o_totalprice", "o_orderdate"})],
)
def test_scans_read_the_columns_they_need(spark, name, columns):
    said = plan(catalogue.QUERIES[name](spark, SF))
    read = {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", said) for c in m.split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,(view|purchase)\)", plan(catalogue.QUERIES["scene_id"](spark, SF)))

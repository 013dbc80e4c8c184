"""Plans and source text: what must never appear at scale."""

import pathlib
import re

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parent.parent
SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"J\d|D6|A\d|W\d|K5|K7", n)])
def test_no_nested_loop_joins(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = entry.queries()["S10_point_lookup"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,77)" in plan
    assert "p_size" not in plan.split("ReadSchema")[1]


def test_library_never_pulls_rows_to_the_driver():
    """The text operators are a part of their own: their few collects are bounded by documented limits."""
    for f in (ROOT / "shelfwatch").rglob("*.py"):
        if "llm" in f.parts:
            continue
        text = f.read_text()
        for word in (".collect()", ".toPandas(", "localCheckpoint", ".rdd", "crossJoin", ".cache()"):
            assert word not in text, (f.name, word)


def test_score_runs_once_per_pair(spark):
    """The score must sit above the pair aggregate, not in the join."""
    plan = entry.queries()["J5_fuzzy_links"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    below = plan.split("ArrowEvalPython")[1]
    assert "shared" in below and "HashAggregate" in below

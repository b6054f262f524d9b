"""Plan checks over every registered query."""

import pytest

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E
    out = {}
    for name, fn in E.queries().items():
        out[name] = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cartesian_products(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p] == []


def test_no_nested_loops(plans):
    assert [n for n, p in plans.items() if "BroadcastNestedLoopJoin" in p] == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []


def test_topk_uses_window_group_limit(plans):
    for n in ("k1_search_files", "b1_bm25", "w1_recent_commits"):
        assert "WindowGroupLimit" in plans[n], n


def test_column_pruning_reaches_scan(spark):
    import __spark_entry__ as E
    df = E.queries()["p_commit_fields"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_python_stage_sees_only_python_files(spark):
    from codeloom.operators import symbols as SY
    from codeloom.sources import proxy as P
    plan = SY.python_symbols(P.files(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    before_python = plan.split("MapInPandas")[1]
    assert "EndsWith" in before_python and ".py" in before_python

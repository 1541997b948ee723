import pytest

from tessarine.plans import catalogue
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == duck_rows(SF, catalogue.ORACLES[name])


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 12


@pytest.mark.parametrize("name", ["bbox_zoom", "bbox_tile", "greedy_suppression", "class_centroid_scores", "nearest_candidate", "run_state", "markdown_html"])
def test_no_python_in_plans(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["last_tool_message"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in plan
    plan = catalogue.QUERIES["report_rois"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan

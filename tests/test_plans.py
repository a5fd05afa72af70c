"""Physical-plan properties of representative queries (explain, no execution)."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cohort_summary", "bmi_bsa", "charlson", "dwell", "lab_conversion", "osmolarity",
                                  "guard_warnings", "derived_record", "baseline_scores", "tree_toy_score"])
def test_no_python_in_scalar_paths(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["lab_conversion", "bag_lookup", "guard_warnings", "osmolarity"])
def test_dictionary_joins_are_broadcast(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


def test_filter_pushed_to_scan(spark):
    plan = _plan(E.queries()["complete_case"](spark, SF_SMALL))
    assert "PushedFilters" in plan and "IsNotNull" in plan


def test_column_pruning(spark):
    df = E.queries()["time_intervals"](spark, SF_SMALL)
    plan = _plan(df)
    scans = [l for l in plan.split("\n") if "FileScan parquet" in l and "orders" in l]
    assert scans and all("o_orderpriority" not in l and "o_orderstatus" not in l for l in scans)


def test_cluster_settings():
    from dwellframe.session import cluster_settings
    s = cluster_settings(100 << 40, executor_cores=4, executors=1000)
    assert int(s["spark.sql.shuffle.partitions"]) >= 2 * 4 * 1000
    assert int(s["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert s["spark.sql.adaptive.skewJoin.enabled"] == "true"

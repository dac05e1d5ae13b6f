"""Plan shape: no Python UDF, no un-partitioned window, one scan per multi-column report."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from contactlens.plans import registry


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(plan) -> list:
    """All nodes of a physical plan, adaptive ones opened."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _nodes(plan.executedPlan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *[n for c in below for n in _nodes(c)]]


def global_windows(df) -> int:
    """Windows without partition keys (all rows in one task)."""
    return sum(n.getClass().getSimpleName() in ("WindowExec", "WindowInPandasExec") and n.partitionSpec().isEmpty()
               for n in _nodes(df._jdf.queryExecution().executedPlan()))


def test_a_global_window_is_found(spark):
    df = spark.range(10)
    assert global_windows(df.withColumn("r", F.row_number().over(Window.orderBy("id")))) == 1
    assert global_windows(df.withColumn("r", F.sum("id").over(Window.partitionBy()))) == 1
    assert global_windows(df.withColumn("r", F.sum("id").over(Window.partitionBy("id")))) == 0


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_no_python_udf_and_no_global_window(spark, key):
    df = registry.QUERIES[key](spark, SF001)
    plan = _plan(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert global_windows(df) == 0


@pytest.mark.parametrize("key", ["crosstab_rate", "categorical_distribution", "correlation_matrix",
                                 "box_summary", "profile_describe", "numeric_histogram",
                                 "target_distribution", "compare_models", "count_by_month_target",
                                 "profile_missing", "monthly_campaign"])
def test_single_scan(spark, key):
    plan = _plan(E.queries()[key](spark, SF001))
    assert plan.count("FileScan parquet") == 1, plan


def test_column_pruning_reaches_scan(spark):
    df = E.queries()["mean_balance_by_target"](spark, SF001)
    plan = _plan(df)
    scan = [ln for ln in plan.splitlines() if "ReadSchema" in ln][0]
    assert "balance" in scan and "job" not in scan


def test_filter_reaches_scan(spark):
    plan = _plan(E.queries()["filter_eq"](spark, SF001))
    scan = [ln for ln in plan.splitlines() if "PushedFilters" in ln][0]
    assert "EqualTo(deposit,yes)" in scan

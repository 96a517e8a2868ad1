"""Exact quantiles and global ranks, in one range and in many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.operators import drift, intervals, outlets
from stockweave.plans.quantiles import column_quantiles, exact_quantiles, feature_quantiles, order_statistics
from stockweave.plans.ranks import rank_all


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(3)
    values = [0.0] * 2000 + [random.gauss(0, 1) for _ in range(3000)] + [random.expovariate(0.001) for _ in range(1000)] + [None] * 50
    return spark.createDataFrame([(v,) for v in values], "v double"), np.array([v for v in values if v is not None])


def jobs(spark, run):
    """How many jobs an action starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    seen = len(tracker.getJobIdsForGroup("counted"))
    run()
    made = len(tracker.getJobIdsForGroup("counted")) - seen
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made


@pytest.mark.parametrize("rows", [10, 700, 1_000_000])
def test_exact_quantiles_equal_numpy(skewed, rows):
    df, values = skewed
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert exact_quantiles(df, "v", wanted, rows) == pytest.approx(list(np.quantile(values, wanted)), abs=1e-12)


def test_many_features_at_once(spark, skewed):
    df, values = skewed
    wanted = [i / 10 for i in range(11)]
    scaled = {f"f{i}": F.col("v") * (i + 1) for i in range(5)} | {"none": F.lit(None).cast("double"), "one": F.lit(4.0)}
    got = column_quantiles(df, scaled, wanted, rows=300)
    for i in range(5):
        assert got[f"f{i}"] == pytest.approx(list(np.quantile(values * (i + 1), wanted)), rel=1e-12, abs=1e-12)
    assert got["none"] == [None] * 11 and got["one"] == [4.0] * 11
    assert feature_quantiles(spark.createDataFrame([], "feature string, value double"), wanted) == {}


def test_jobs_do_not_grow_with_features_or_ranks(spark, skewed):
    df, _ = skewed
    few = jobs(spark, lambda: column_quantiles(df, {"a": "v"}, [0.5], rows=500))
    many = jobs(spark, lambda: column_quantiles(df, {f"f{i}": F.col("v") + i for i in range(12)}, [i / 20 for i in range(21)], rows=500))
    assert abs(many - few) <= 2  # adaptive execution may start a stage as a job of its own


def test_order_statistic_and_empty_column(spark, skewed):
    df, values = skewed
    n, found = order_statistics(df, "v", lambda n: [17], rows=50)
    assert n == len(values) and found[17] == np.sort(values)[17]
    assert exact_quantiles(df.filter("v IS NULL"), "v", [0.5]) == [None]


@pytest.mark.parametrize("rows", [5, 400, 100_000])
@pytest.mark.parametrize("method", ["dense", "min"])
def test_global_rank(spark, skewed, rows, method):
    import pandas as pd

    df, values = skewed
    got = rank_all(df, "v", "r", method=method, rows=rows).toPandas()
    assert len(got) == df.count()
    for descending in (True, False):
        got = rank_all(df, "v", "r", method=method, descending=descending, rows=rows).toPandas()
        expected = pd.Series(got["v"]).rank(method=method, ascending=not descending)
        known = got["v"].notna()
        assert (got["r"][known].astype(float) == expected[known]).all()
        assert got["r"][~known].isna().all()


def test_rank_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "v double, r0 int")
    assert rank_all(empty, "v", "r").columns == ["v", "r0", "r"] and rank_all(empty, "v", "r").count() == 0


def test_report_of_top_outlets_ranks_nothing(spark, facts):
    from stockweave.plans.demand_queries import demand
    from conftest import SF

    plan = outlets.top_outlets(outlets.performance_indices(demand(spark, SF)), "risk_index")._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]


def test_interval_and_drift_use_one_selection(spark, skewed):
    df, values = skewed
    rows = df.select(F.col("v").alias("actual"), F.lit(0.25).alias("predicted"))
    got = intervals.probabilistic_forecast(rows.limit(1), rows).first()
    residual = values - 0.25
    n = len(residual)
    radius = np.sort(np.abs(residual))[int(np.ceil(round((n + 1) * 0.9, 9))) - 1]
    assert got["upper"] == pytest.approx(0.25 + radius) and got["p90"] == pytest.approx(0.25 + np.quantile(residual, 0.9))
    report = drift.drift_report(df.withColumn("w", F.col("v") + 1), df.withColumn("w", F.col("v") * 2), ["v", "w", "absent"])
    assert {r.feature: r.drifted for r in report.collect()}["w"]
    with pytest.raises(ValueError):
        intervals.probabilistic_forecast(rows, rows.filter("actual IS NULL"))

"""Metamorphic leakage tests, golden values and plan shape of the series operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockweave.operators import leakage, lost_demand, models, series, spikes, stockout
from stockweave.sources import demand_tables as src


def rows(spark, values, start=dt.date(2025, 1, 1), outlet="O1", product="P1", name="quantity_sold"):
    data = [(outlet, product, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"outlet_id string, product_id string, date date, {name} double")


@pytest.mark.parametrize("operator", [series.lag_features, series.rolling_features, series.trend_features,
                                      series.volatility_features, series.order_velocity, series.compact_features,
                                      series.demand_dynamics, series.outlet_product_features, series.temporal_features])
def test_changing_today_never_moves_features_up_to_today(spark, operator):
    base = rows(spark, [10 + i % 7 for i in range(60)])
    day = dt.date(2025, 2, 15)
    changed = base.withColumn("quantity_sold", F.when(F.col("date") == F.lit(day), 999.0).otherwise(F.col("quantity_sold")))
    past = lambda df: [r.asDict() for r in operator(df).drop("quantity_sold").filter(F.col("date") <= F.lit(day)).orderBy("date").collect()]
    assert past(base) == past(changed)


def test_full_windows_only(spark):
    out = series.rolling_features(rows(spark, range(1, 11))).orderBy("date").collect()
    assert out[2]["rolling_mean_3"] is None
    assert out[3]["rolling_mean_3"] == 2.0
    assert out[3]["rolling_std_3"] == 1.0


def test_one_exchange_for_a_chain_of_series_operators(spark, facts):
    df = facts.transform(series.lag_features).transform(series.rolling_features).transform(series.trend_features)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(outlet_id") == 1
    assert plan.count("Sort [") == 1


def test_model_features_are_complete_and_pass_the_audit(spark, facts):
    featured = series.model_features(facts)
    assert len(series.MODEL_FEATURES) == 51 and set(series.MODEL_FEATURES) <= set(featured.columns)
    assert leakage.leakage_audit(featured, series.MODEL_FEATURES).filter(~F.col("passed")).count() == 0
    assert leakage.compact_contract()["passed"]
    assert not leakage.compact_contract(["lag_1", "quantity_sold"])["passed"]


def test_state_features_equal_features_of_an_appended_row(spark, facts):
    history = facts.select("outlet_id", "product_id", "date", "quantity_sold")
    day = dt.date(2030, 1, 1)
    future = history.select("outlet_id", "product_id").distinct().withColumn("date", F.lit(day))
    slow = models.future_features(history, future)
    fast = models.state_features(models.series_state(history), day)
    key = ["outlet_id", "product_id"]
    names = list(series.MODEL_FEATURES)
    joined = slow.select(*key, *[F.col(c).alias(f"a_{c}") for c in names]).join(
        fast.select(*key, *[F.col(c).alias(f"b_{c}") for c in names]), key)
    bad = joined.agg(*[F.count(F.when(leakage._differs(F.col(f"a_{c}"), F.col(f"b_{c}")), 1)).alias(c) for c in names]).first()
    assert all(v == 0 for v in bad), bad
    assert joined.count() == future.count()


def stockout_frame(spark):
    data = []
    for i in range(30):
        out = 10 <= i < 15
        data.append(("O1", "P1", dt.date(2025, 1, 1) + dt.timedelta(days=i), 12.0 if out else 20.0, 20.0, 8.0 if out else 0.0, out))
    return spark.createDataFrame(data, "outlet_id string, product_id string, date date, quantity_sold double, "
                                       "deconstrained_demand double, estimated_lost_demand double, stockout boolean")


def test_stockout_event_golden_values(spark):
    (event,) = stockout.event_summary(stockout_frame(spark)).collect()
    assert event["event_duration_days"] == 5
    assert event["event_lost_demand"] == 40.0


def test_reconstruction_raises_demand_only_on_stockout_days(spark):
    sales = rows(spark, [10.0] * 30 + [5.0] * 10)
    stock = sales.select("outlet_id", "product_id", "date", F.lit(0.0).alias("closing_stock"),
                         (F.col("quantity_sold") == 5.0).alias("stockout"))
    out = {r["date"]: r for r in stockout.deconstrain(sales, stock).collect()}
    clean = [r for r in out.values() if not r["stockout"]]
    assert all(r["deconstrained_demand"] == 10.0 and r["estimated_lost_demand"] == 0.0 for r in clean)
    first = out[dt.date(2025, 1, 31)]
    assert first["deconstrained_demand"] == pytest.approx(10.0) and first["stockout_duration"] == 1
    fifth = out[dt.date(2025, 2, 4)]
    assert fifth["deconstrained_demand"] == pytest.approx(11.0)  # capped at +10 %


def test_known_spike_is_found(spark):
    values = [20.0] * 73 + [100.0] * 3 + [20.0] * 14
    found = spikes.spike_analysis(rows(spark, values)).filter("is_demand_spike").orderBy("date").collect()
    assert [r["date"] for r in found] == [dt.date(2025, 3, 15) + dt.timedelta(days=i) for i in range(len(found))]
    assert found and found[0]["spike_severity"] in ("major", "extreme")


def test_loss_columns_of_the_first_day(spark):
    first = lost_demand.loss_analysis(stockout_frame(spark)).orderBy("date").first()
    assert first["stockout_days_7d"] == 0.0 and first["lost_demand_7d"] is None and first["loss_acceleration"] == 1.0


def test_null_keys_and_missing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        stockout.deconstrain(rows(spark, [1.0]), rows(spark, [1.0]))
    with pytest.raises(ValueError):
        series.compact_features(rows(spark, [1.0]).drop("date"))

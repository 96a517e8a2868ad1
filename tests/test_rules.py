"""Contracts: what must be refused, counted or reported."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockweave.operators import (baselines, decisions, ensemble, intervals, leakage, metrics, quality, scenario, supply,
                                  text_features, validators)


def test_bom_requirement_and_order_rounding(spark):
    day = dt.date(2025, 1, 1)
    demand = spark.createDataFrame([("O1", "P1", day, 25.0)], "outlet_id string, product_id string, date date, demand double")
    bom = spark.createDataFrame([("P1", "P002", 1.0, "kg")], "product_id string, supply_product_id string, quantity_per_unit double, supply_unit string")
    stock = spark.createDataFrame([("O1", day, "P002", 3.0, 0.0)], "outlet_id string, date date, product_id string, closing_stock double, received_stock double")
    contract = spark.createDataFrame([("P002", "S", 3, 5.0, 5.0)], "supply_product_id string, supplier_id string, lead_time_days int, minimum_order_quantity double, order_multiple double")
    need = supply.supply_demand(demand, supply.normalize_bom(bom))
    assert need.first()["required_supply"] == 25.0
    out = supply.supply_recommendations(need, stock, supply.normalize_contract(contract))
    row = out.first()
    assert row["shortage"] == 97.0 and row["recommended_order_quantity"] == 100.0
    assert validators.passed(validators.supply_rules(out))
    assert not validators.passed(validators.supply_rules(out.withColumn("true_demand", F.lit(1.0))))
    assert not validators.passed(validators.supply_rules(out.withColumn("shortage", F.lit(1.0))))


@pytest.mark.parametrize("bad", [[("P1", "S1", 0.0)], [("P1", None, 1.0)], [("P1", "S1", 1.0), ("P1", "S1", 2.0)], []])
def test_bad_bom_is_refused(spark, bad):
    schema = "product_id string, supply_product_id string, quantity_per_unit double"
    with pytest.raises(ValueError):
        supply.normalize_bom(spark.createDataFrame(bad, schema).withColumn("supply_unit", F.lit("kg")))


def test_reorder_formulas(spark):
    df = spark.createDataFrame([([10.0, 12.0, 14.0], 4.0, 2, 5.0, 6.0)],
                               "daily_forecast array<double>, demand_std double, lead_time_days int, inventory_position double, pack_size double")
    row = supply.inventory_recommendations(df).first()
    assert row["lead_time_demand"] == 22.0
    assert row["safety_stock"] == pytest.approx(1.6449 * 4 * 2 ** 0.5)
    assert row["recommended_order_quantity"] % 6 == 0 and row["stockout_risk"] and row["reorder"]
    with pytest.raises(Exception):
        supply.inventory_recommendations(df.withColumn("lead_time_days", F.lit(9))).collect()
    with pytest.raises(ValueError):
        supply.safety_stock("demand_std", "lead_time_days", 0.5)


def test_scenarios(spark):
    with pytest.raises(ValueError):
        scenario.scenario("x", holiday_multiplier=2.5)
    with pytest.raises(ValueError):
        scenario.scenario("x", moon_multiplier=1.1)
    assert scenario.combined_multiplier({"a": 2.0, "b": 0.5}) == 1.0
    base = spark.createDataFrame([(0.0,), (10.0,)], "baseline_demand double")
    out = scenario.compare_scenarios(base, [scenario.scenario("base"), scenario.scenario("up", event_multiplier=1.5)])
    assert out.count() == 4 and validators.passed(validators.scenario_rules(out))
    found = {r["scenario_name"]: r for r in scenario.scenario_summary(out).collect()}
    assert found["up"]["percentage_change"] == pytest.approx(50.0) and found["base"]["absolute_change"] == 0.0


def test_governance_gates(spark):
    base = [("O", "P", 10.0, 0.0, 1.0, False, False), ("O", "P", 10.0, 0.0, 0.4, False, False),
            ("O", "P", 10.0, 0.0, 1.0, True, False), ("O", "P", 10.0, 0.0, 1.0, False, True), ("O", "P", 1.0, 50.0, 1.0, False, False)]
    df = spark.createDataFrame(base, "outlet_id string, product_id string, forecast_demand double, current_inventory double, "
                                     "demand_confidence double, high_risk boolean, drift_signal boolean")
    out = [r["commercial_action"] for r in decisions.autonomous_decisions(df).collect()]
    assert out == ["URGENT_REPLENISHMENT", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "NO_REPLENISHMENT"]
    with pytest.raises(Exception):
        decisions.decide(df.withColumn("forecast_demand", F.lit(-1.0))).collect()


def test_baselines_golden(spark):
    day = dt.date(2025, 1, 1)
    history = spark.createDataFrame([("O", "P", day + dt.timedelta(days=i), float(i + 1)) for i in range(10)],
                                    "outlet_id string, product_id string, date date, quantity_sold double")
    out = baselines.baseline_forecast(history, 9).collect()
    by = {m: [r["prediction"] for r in sorted(out, key=lambda r: r["horizon"]) if r["method"] == m] for m in baselines.METHODS}
    assert by["naive"] == [10.0] * 9
    assert by["seasonal_naive"] == [4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 4.0, 5.0]
    assert by["moving_average"] == [7.0] * 9
    short = baselines.baseline_forecast(history.limit(3), 2, ["seasonal_naive", "moving_average"]).collect()
    assert {r["prediction"] for r in short if r["method"] == "seasonal_naive"} == {3.0}
    assert {r["prediction"] for r in short if r["method"] == "moving_average"} == {2.0}


def test_conformal_radius_is_an_order_statistic(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(1, 100)], "actual double, predicted double")
    assert intervals.conformal_radius(df) == 90.0
    out = intervals.probabilistic_forecast(df, df)
    assert out.filter("lower < 0 OR p10 < 0").count() == 0
    assert intervals.forecast_violations(out).first()["lower_above_upper"] == 0
    with pytest.raises(ValueError):
        intervals.conformal_radius(df.filter("actual < 0"))


def test_weights_drop_weak_models_and_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 100.0, 1.0)], "model_name string, mae double, stability double")
    out = {r["model_name"]: r for r in ensemble.model_weights(df).collect()}
    assert out["c"]["weight"] == 0.0 and out["a"]["weight"] == pytest.approx(2 / 3)
    assert sum(r["weight"] for r in out.values()) == pytest.approx(1.0) and out["a"]["selected_model"] == "a"


def test_smape_variants(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0)], "actual double, predicted double")
    got = {v: df.agg(F.avg(metrics.smape_term("actual", "predicted", v))).first()[0] for v in ("skip", "zero", "epsilon", "threshold")}
    assert got["skip"] == pytest.approx(2 / 3) and got["zero"] == got["threshold"] == pytest.approx(1 / 3)


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", -1.0, "2025-01-01"), (None, 3.0, "nope"), (None, 99.0, "2026-01-01")], "k string, v double, d string")
    out = {(r["check"], r["column"]): r["violations"] for r in quality.column_checks(
        df, ["k", "zz"], ["v"], {"v": (0, 10)}, ["d"], {"d": ("2025-01-01", "2025-12-31")}).collect()}
    assert out == {("no_nulls", "k"): 2, ("no_nulls", "zz"): -1, ("non_negative", "v"): 1, ("bounds", "v"): 2,
                   ("valid_date", "d"): 1, ("date_range", "d"): 1}
    assert quality.unique_key(df, "k").first()["violations"] == 1
    parent = spark.createDataFrame([("a",)], "k string")
    assert quality.foreign_keys(df, parent, "k").first()["violations"] == 2
    assert quality.normalize_nulls(spark.createDataFrame([("NA",), ("x",)], "c string")).filter("c IS NULL").count() == 1
    errors = quality.record_errors(spark.createDataFrame([("O", "2025-13-01", "P", -1.0, None, 1.0)],
                                   "outlet_id string, date string, product_id string, quantity_sold double, unit string, revenue double"), "sales")
    assert set(errors.first()["errors"]) == {"unit: missing", "date: not a date", "quantity_sold: out of range"}


def test_firewall_names():
    assert leakage.firewall_violations(["lag_1", "future_sales", "demand_truth", "recovery_ratio"]) == ["future_sales", "demand_truth", "recovery_ratio"]
    assert leakage.is_known_context("holiday_active") and not leakage.is_known_context("future_holiday")


def test_text_signals(spark):
    df = spark.createDataFrame([(1, "Special DISCOUNT, special deal! dine-in"), (2, None), (3, "public holiday")], "id int, text string")
    out = {r["id"]: r for r in text_features.text_features(df).collect()}
    assert out[1]["text_promotion_count"] == 4 and out[1]["text_dine_in_count"] == 1 and out[1]["text_token_count"] == 5
    assert out[2]["text_quality"] == 0.0 and out[2]["text_token_count"] == 0
    assert out[3]["text_holiday_count"] == 1
    with pytest.raises(ValueError):
        text_features.fuse(df, weights={"numeric": -1.0, "text": 1.0, "visual": 1.0})

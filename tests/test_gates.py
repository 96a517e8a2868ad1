"""Contracts hold for actions that read none of the checked columns, and nothing is refused in silence."""

import datetime as dt
import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from stockweave.operators import admission, client, cultural, daily, decisions, quality, scenario, segments, supply
from stockweave.sources import demand_tables as src
from stockweave.sources import readers

DAY = dt.date(2025, 1, 1)


def fails(*actions):
    for action in actions:
        with pytest.raises(Exception):
            action()


def test_a_negative_quantity_refuses_the_feed(spark):
    rows = spark.createDataFrame([("O", "P", DAY, 1.0), ("O", "P", DAY, -1.0)], "outlet_id string, product_id string, date date, quantity_sold double")
    fails(lambda: readers.canonical_feed(rows), lambda: readers.canonical_feed(rows).limit(1), lambda: readers.daily_grain(readers.canonical_feed(rows)))
    with pytest.raises(admission.Refused, match="negative quantity_sold:1"):
        readers.canonical_feed(rows.limit(5))
    good = readers.canonical_feed(rows.filter("quantity_sold > 0"))
    assert good.count() == 1 and good.columns == rows.columns


def test_inputs_are_judged_as_a_whole(spark):
    schema = "outlet_id string, product_id string, date string, quantity_sold double"
    good = spark.createDataFrame([("O", "P", "2025-01-01", 1.0), ("O", "P", "2025-01-02", 2.0)], schema)
    bad = good.unionByName(spark.createDataFrame([("O", "P", "x", 1.0), ("O", "P", None, None)], schema))
    assert admission.training_input(good).count() == 2 and admission.strict_history(good, "quantity_sold").schema["date"].dataType.simpleString() == "date"
    for gate, message in ((admission.training_input, "null date:1, null quantity_sold:1"),
                          (lambda df: admission.strict_history(df, "quantity_sold"), "invalid date:2, invalid quantity_sold:1")):
        with pytest.raises(admission.Refused, match=message):
            gate(bad)
    assert admission.prepared_history(bad).count() == 2
    for gate in (admission.training_input, admission.prepared_history, admission.calendar_input, cultural.prepare_calendar,
                 lambda df: admission.learning_data(df, "quantity_sold", "reference")):
        with pytest.raises(admission.Refused):
            gate(good.limit(0))
        with pytest.raises(admission.Refused, match="missing date"):
            gate(good.drop("date"))
    assert admission.strict_history(good.limit(0), "quantity_sold").count() == 0
    with pytest.raises(admission.Refused, match="null date:1"):
        admission.training_input(bad.fillna(0.0, ["quantity_sold"]), store=False)
    assert {r.rule: r.violations for r in admission.violations(bad, {"a": F.col("date").isNull(), "b": F.lit(False)}).collect()} == {"a": 1, "b": 0}


def test_an_unknown_outlet_fails_every_action(spark):
    known = src.outlets(spark, SF)
    rows = known.select("outlet_id").limit(2).unionByName(spark.createDataFrame([("nowhere",)], "outlet_id string"))
    fails(daily.with_outlet_identity(rows, known).count, daily.with_outlet_identity(rows, known).groupBy("outlet_id").count().collect)
    assert daily.with_outlet_identity(rows.filter("outlet_id <> 'nowhere'"), known).count() == 2


@pytest.mark.parametrize("bad", [1.5, -0.1, None])
def test_calendar_importance(spark, bad):
    rows = spark.createDataFrame([("O", DAY, bad)], "outlet_id string, date date, holiday_importance double")
    fails(cultural.prepare_calendar(rows).count)
    assert cultural.prepare_calendar(rows.fillna(0.5).withColumn("holiday_importance", F.lit(0.5))).count() == 1


def test_requests_scenarios_and_lead_times(spark):
    asked = spark.createDataFrame([("O", "P", -1.0)], "outlet_id string, product_id string, forecast_demand double")
    fails(decisions.decide(asked).count)
    assert decisions.decide(asked.withColumn("forecast_demand", F.lit(1.0))).count() == 1
    base = spark.createDataFrame([(1.0, "x")], "baseline_demand double, weather_multiplier string")
    fails(scenario.apply_scenario(base).count)
    assert scenario.apply_scenario(base.withColumn("weather_multiplier", F.lit("1.1"))).count() == 1
    pairs = spark.createDataFrame([([1.0, 2.0], 1.0, 3, 1.0, 6.0)], "daily_forecast array<double>, demand_std double, "
                                  "lead_time_days int, inventory_position double, pack_size double")
    fails(supply.inventory_recommendations(pairs).count)
    assert supply.inventory_recommendations(pairs.withColumn("lead_time_days", F.lit(2))).count() == 1


def test_a_gate_passes_an_empty_table(spark):
    assert scenario.apply_scenario(spark.createDataFrame([], "baseline_demand double, weather_multiplier double")).count() == 0


def test_refused_request_rows_have_a_reason(spark):
    sold = [("2025-01-01", 5), ("2025-01-01", -5), ("x", 3), ("2025-01-02", "many"), (None, 1)]
    body = {"client_id": "c", "sales": [{"date": d, "outlet_id": "O", "product_id": "P", "quantity_sold": q} for d, q in sold]}
    tables = readers.request_tables(spark.createDataFrame([(json.dumps(body),)], "value string"))
    assert [r["quantity_sold"] for r in tables["sales"].collect()] == [5.0]
    refused = sorted((r["reason"], r["quantity_sold"]) for r in tables["refused"].collect())
    assert refused == [("INVALID_DATE", "1"), ("INVALID_DATE", "3"), ("INVALID_QUANTITY_SOLD", "many"), ("NEGATIVE_QUANTITY", "-5")]


def test_lead_times_beyond_a_week(spark):
    sales = spark.createDataFrame([("O", p, DAY + dt.timedelta(days=i), 2.0) for p in ("P", "Q", "R") for i in range(28)],
                                  "outlet_id string, product_id string, date date, quantity_sold double")
    wide = spark.createDataFrame([("O", p, *[2.0] * 9) for p in ("P", "Q", "R")],
                                 "outlet_id string, product_id string, " + ", ".join(f"d{i} double" for i in range(1, 10)))
    stock = spark.createDataFrame([("O", "P", 0.0, 9), ("O", "Q", 0.0, 30), ("O", "R", 0.0, 1)],
                                  "outlet_id string, product_id string, current_inventory double, lead_time_days int")
    names = spark.createDataFrame([("O", "O")], "outlet_id string, name string"), spark.createDataFrame([("P", "P")], "product_id string, name string")
    out = {r["product_id"]: r for r in client.client_actions(wide, sales, stock, *names).collect()}
    assert out["P"]["lead_time_demand"] == 18.0 and out["P"]["recommended_order"] == 18.0 and out["P"]["d7"] == 14.0
    assert out["Q"]["action"] == "LONGER_FORECAST_REQUIRED" and out["Q"]["lead_time_days"] == 30 and out["Q"]["recommended_order"] is None
    assert out["R"]["action"] == "REPLENISH" and out["R"]["lead_time_demand"] == 2.0
    with pytest.raises(ValueError):
        client.client_actions(wide.drop("d5"), sales, stock, *names)
    with pytest.raises(ValueError):
        client.demonstration(None, lead_time_days=8)


def test_cluster_search_keeps_the_cheapest_start(spark):
    rows = [(f"O{i}", *[float((i % 3) * 10 + (i * 7 + j) % 3 * 0.1) for j in range(len(segments.FEATURES))]) for i in range(12)]
    table = spark.createDataFrame(rows, "outlet_id string, " + ", ".join(f"{c} double" for c in segments.FEATURES))
    best = segments.evaluate_kmeans(segments.clustering_matrix(table), 2, 4, restarts=3)
    assert best[0]["n_clusters"] == 3 and [r["silhouette_score"] for r in best] == sorted((r["silhouette_score"] for r in best), reverse=True)

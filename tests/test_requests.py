"""Client requests from JSON to actions."""

import datetime as dt
import json

import pytest

from stockweave.operators import requests

DAY = dt.date(2025, 1, 1)


def body(client, series, days=40, **more):
    sales = [{"date": str(DAY + dt.timedelta(days=i)), "outlet_id": o, "product_id": p, "quantity_sold": 2 + i % 3 + (5 if i >= days - 7 and p == "Q" else 0)}
             for o, p in series for i in range(days)]
    return json.dumps({"client_id": client, "sales": sales, **more})


@pytest.fixture(scope="module")
def asked(spark):
    stock = [{"outlet_id": "O", "product_id": "P", "current_inventory": 1.0, "lead_time_days": 2}, {"outlet_id": "O", "product_id": "Q", "current_inventory": 9999.0}]
    rows = [body("a", [("O", "P"), ("O", "Q"), ("O", "R")], inventory=stock, top_n=2, include_normal=True, as_of_date="2025-03-01"),
            body("b", [("O", "P"), ("X", "P")], days=36, inventory=stock[:1]), body("c", [("O", "P")], days=12),
            json.dumps({"client_id": "d", "sales": [{"date": "x", "outlet_id": "O", "product_id": "P", "quantity_sold": 1}]}), "not json",
            json.dumps({"client_id": None, "sales": [{"date": "2025-01-01", "outlet_id": "O", "product_id": "P", "quantity_sold": 1}]})]
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_every_client_is_judged_and_the_others_are_answered(asked):
    answer = requests.answer(asked, requests.seasonal)
    gate = {r.client_id: r.reason for r in answer.gate.collect()}
    assert gate == {"a": None, "b": None, "c": "INSUFFICIENT_HISTORY:1", "d": "NO_VALID_SALES"}
    actions = {(r.client_id, r.outlet_id, r.product_id): r for r in answer.actions.collect()}
    assert set(actions) == {("a", "O", "P"), ("a", "O", "Q"), ("b", "O", "P")}  # two of three for a; b asked for no normal actions
    assert actions["a", "O", "P"].report_date == dt.date(2025, 3, 1) and actions["b", "O", "P"].report_date == DAY + dt.timedelta(days=36)
    assert actions["a", "O", "P"].action == "REPLENISH" and actions["a", "O", "Q"].action == "NO_ACTION"
    assert actions["a", "O", "P"].place == 1
    summary = {r.client_id: r for r in answer.summary.collect()}
    assert (summary["a"].series, summary["a"].actions_returned, summary["a"].inventory_rows, summary["b"].outlets) == (3, 2, 2, 2)
    assert sorted(r.reason for r in answer.refused_rows.collect()) == ["INVALID_DATE", "NO_CLIENT"]


def test_trees_forecast_every_client_from_its_own_last_day(asked):
    sales = requests.readers.request_tables(asked)["sales"].filter("client_id IN ('a', 'b')")
    out = requests.trees(max_iter=2, max_depth=2, min_rows=10)(sales).collect()
    assert len(out) == 5 * 7 and all(r.prediction >= 0 for r in out)
    first = {r.client_id: r.date for r in out if r.horizon == 1}
    assert first == {"a": DAY + dt.timedelta(days=40), "b": DAY + dt.timedelta(days=36)}


def test_a_client_gets_at_most_what_it_asked_for(spark):
    series = [(f"O{i:02}", "P") for i in range(30)]
    many = spark.createDataFrame([(body("a", [s], days=35, include_normal=True, top_n=n),) for s, n in zip(series, (3, 7, *[None] * 28))], "value string")
    got = requests.answer(many, requests.seasonal).actions.orderBy("place").collect()
    assert [r.outlet_id for r in got] == [f"O{i:02}" for i in range(7)] and [r.place for r in got] == list(range(1, 8))
    assert requests.answer(many.limit(0), requests.seasonal).actions.collect() == []

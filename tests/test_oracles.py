"""A spread of the registered queries against their SQL on the smallest data set, compared value by value."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

ORACLES = entry.oracle_sql()
# A spread over all modules; tools/check.py runs the whole registry.
CHOSEN = ["facts_daily", "time_features", "rolling_features", "demand_dynamics", "outlet_product_features",
          "deconstrained_demand", "censoring_analysis", "loss_rollups", "loss_rank", "spike_analysis",
          "cultural_effects", "outlet_profiles", "outlet_performance", "supply_recommendations", "scenario_summary",
          "daily_actions", "autonomous_decisions", "baseline_forecasts", "model_ranking", "hybrid_evaluation",
          "probabilistic_forecast", "drift_report", "estimate_validation", "client_feed", "text_features", "client_actions",
          "horizon_evaluation", "daily_counts_by_risk", "clean_reference", "inventory_recommendations",
          "ingest_manifest", "ingest_quarantine", "ingest_sales", "ingest_sufficiency", "gate_outcomes", "gate_violations",
          "client_request_gate", "client_request_orders", "client_request_summary", "rolling_origin_metrics", "attached_items",
          "diagnostic_report", "leaked_audit_report", "daily_short_series", "daily_action_deep_page", "future_features",
          "window_features", "column_classes", "report_round_trip", "processed_dataset", "facts_of_long_series"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())

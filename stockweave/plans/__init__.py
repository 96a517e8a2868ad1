"""Query plans: named queries over the test tables, exact quantiles, ranks, lineage cuts."""

from importlib import import_module

QUERY_MODULES = ("feature_queries", "demand_queries", "outlet_queries", "supply_queries",
                 "decision_queries", "forecast_queries", "metric_queries", "quality_queries",
                 "text_queries", "model_queries", "validator_queries", "ingest_queries",
                 "request_queries", "contract_queries", "rolling_queries",
                 "ablation_queries")


def load_queries():
    """Import every query module once and return the registry."""
    from .registry import QUERIES

    for module in QUERY_MODULES:
        import_module(f"{__name__}.{module}")
    return QUERIES

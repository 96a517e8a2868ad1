"""Client requests from JSON to ranked actions, many clients in one plan.

A request brings sales, inventory and names as JSON. All requests are worked on together with
`client_id` as the first key: rows that cannot be used are set aside with a reason, a client whose
history is too short is refused as a whole while the others are answered, the forecast is one
recursive pass over all series, and each client gets as many actions as it asked for.

Where a client sends several rows, the latest `as_of_date`, the largest `top_n` and any wish for
normal actions hold. A missing `top_n` is 50, a missing `as_of_date` the day after the last sale.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_where
from ..functions.windows import SERIES
from ..plans.lineage import cut
from ..sources import readers
from . import baselines, client, models, series

KEYS = ("client_id", *SERIES)
MINIMUM_DAYS = 35
DEFAULT_TOP, MOST_TOP = 50, 500
SPREAD = 32  # places among which a client's actions are dealt before the last ranking

Forecaster = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Answer:
    actions: DataFrame
    summary: DataFrame
    gate: DataFrame
    refused_rows: DataFrame


def options(requests: DataFrame, column: str = "value") -> DataFrame:
    """(client_id, as_of_date, top_n, include_normal) of every client that is named."""
    asked = requests.select(F.from_json(column, readers.REQUEST_SCHEMA).alias("r")).select("r.*").filter("client_id IS NOT NULL")
    one = asked.groupBy("client_id").agg(F.max(F.col("as_of_date").try_cast("date")).alias("as_of_date"), F.max("top_n").alias("top_n"),
                                         F.coalesce(F.max("include_normal"), F.lit(False)).alias("include_normal"))
    return one.withColumn("top_n", F.greatest(F.lit(1), F.least(F.lit(MOST_TOP), F.coalesce("top_n", F.lit(DEFAULT_TOP)))))


def history_gate(asked: DataFrame, sales: DataFrame, minimum_days: int = MINIMUM_DAYS) -> DataFrame:
    """Per client: rows, series, shortest and longest history, last day, and why it is refused, if it is."""
    days = sales.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"), F.max("date").alias("last_date"))
    quality = days.groupBy("client_id").agg(
        F.sum("n").alias("sales_rows"), F.count_distinct("outlet_id").alias("outlets"), F.count_distinct("product_id").alias("products"),
        F.count(F.lit(1)).alias("series"), F.min("days").alias("minimum_history_days"), F.max("days").alias("maximum_history_days"),
        count_where(F.col("days") < minimum_days).alias("short_series"), F.max("last_date").alias("last_date"))
    reason = (F.when(F.col("sales_rows").isNull(), "NO_VALID_SALES")
               .when(F.col("short_series") > 0, F.concat(F.lit("INSUFFICIENT_HISTORY:"), F.col("short_series").cast("string"))))
    return asked.join(quality, "client_id", "left").withColumn("reason", reason)


def trees(**training) -> Forecaster:
    """One model for all clients' rows, then seven recursive steps from the day after each client's last sale."""

    def forecast(sales: DataFrame) -> DataFrame:
        starts = sales.groupBy("client_id").agg(F.date_add(F.max("date"), 1).alias("_start"))
        model = models.train(series.model_features(sales, keys=KEYS), series.MODEL_FEATURES, **training)
        return models.recursive_forecast(model, sales, starts, 7, keys=KEYS)

    return forecast


def seasonal(sales: DataFrame) -> DataFrame:
    """The last week of each series again."""
    return baselines.baseline_forecast(sales, 7, ["seasonal_naive"], keys=KEYS)


def best(actions: DataFrame) -> DataFrame:
    """The first `top_n` actions of each client by priority; ranked in places first, so that a large client is not one task's work."""
    order = [client.priority_order(), *SERIES]
    for group in (["client_id", F.pmod(F.xxhash64(*SERIES), F.lit(SPREAD))], ["client_id"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        actions = actions.withColumn("place", place).filter(F.col("place") <= MOST_TOP)
    return actions.filter("place <= top_n")


def answer(requests: DataFrame, forecast: Forecaster | None = None, minimum_days: int = MINIMUM_DAYS, column: str = "value") -> Answer:
    """Actions and summaries of the admitted clients, the verdict on every client, and the rows set aside."""
    tables = readers.request_tables(requests, column)
    sales = cut(tables["sales"])
    gate = cut(history_gate(options(requests, column), sales, minimum_days))
    admitted = gate.filter("reason IS NULL")
    sold = cut(sales.join(admitted.select("client_id"), "client_id", "left_semi"))
    known = {name: tables[name].join(admitted.select("client_id"), "client_id", "left_semi") for name in ("inventory", "outlets", "products")}
    wide = baselines.pivot_horizon((forecast or trees())(sold), KEYS)
    made = client.client_actions(wide, sold, known["inventory"], known["outlets"], known["products"], include_normal=True, keys=KEYS)
    wishes = admitted.select("client_id", "top_n", "include_normal", F.coalesce("as_of_date", F.date_add("last_date", 1)).alias("report_date"))
    actions = cut(best(made.join(wishes, "client_id").filter("include_normal OR priority <> 'LOW'")))
    counts = actions.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("actions_returned"), count_where(F.col("priority") == "HIGH").alias("high_priority"),
        count_where(F.col("priority") == "MODERATE").alias("moderate_priority"), count_where(F.col("action") == "REPLENISH").alias("replenishment_actions"))
    summary = admitted.drop("reason", "short_series", "top_n", "include_normal", "as_of_date").join(wishes.select("client_id", "report_date"), "client_id")
    for name, table in known.items():
        summary = summary.join(table.groupBy("client_id").agg(F.count(F.lit(1)).alias(f"{name}_rows")), "client_id", "left")
    summary = summary.join(counts, "client_id", "left")
    summary = summary.fillna(0, [c for c in summary.columns if c.endswith(("_rows", "_returned", "_priority", "_actions"))])
    return Answer(actions.drop("top_n", "include_normal"), summary, gate, tables["refused"])

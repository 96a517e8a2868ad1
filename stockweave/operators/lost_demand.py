"""Lost-demand metrics, patterns, severity and priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (clip, column_or, count_where, first_rule, flag, ratio, require_columns,
                               share, to_number, total)
from ..functions.windows import DAY_KEY, SERIES, lagged, rolling
from ..plans.ranks import dense_rank_all

INPUT = (*DAY_KEY, "quantity_sold", "deconstrained_demand", "estimated_lost_demand", "stockout")

# Weight of a severity class in the priority score.
SEVERITY_WEIGHT = {"low": 1.0, "moderate": 1.5, "high": 2.5, "critical": 4.0}


def loss_metrics(df: DataFrame) -> DataFrame:
    require_columns(df, INPUT, "loss_metrics")
    sold = F.greatest(F.coalesce(to_number("quantity_sold"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("quantity_sold", sold)
    df = df.withColumn(
        "deconstrained_demand",
        F.greatest(F.coalesce(to_number("deconstrained_demand"), F.col("quantity_sold")), F.lit(0.0)))
    demand, sold = F.col("deconstrained_demand"), F.col("quantity_sold")
    df = df.withColumn(
        "estimated_lost_demand",
        F.greatest(F.coalesce(to_number("estimated_lost_demand"), F.lit(0.0)), F.lit(0.0), demand - sold))
    lost = F.col("estimated_lost_demand")
    df = df.withColumns({
        "demand_opportunity": demand,
        "lost_demand_rate": share(lost, demand, 0.0),
        "realized_demand_rate": share(sold, demand, 1.0),
        "lost_demand_flag": lost > 0,
    })
    rate = F.col("lost_demand_rate")
    return df.withColumns({
        "material_lost_demand_flag": rate >= 0.10,
        "severe_lost_demand_flag": rate >= 0.25,
        "lost_demand_value_index": lost * rate,
    })


def _loss_measures():
    return [
        F.sum("quantity_sold").alias("total_observed_sales"),
        F.sum("deconstrained_demand").alias("total_deconstrained_demand"),
        F.sum("estimated_lost_demand").alias("total_estimated_lost_demand"),
        F.avg("lost_demand_rate").alias("average_lost_demand_rate"),
        count_where(F.col("stockout")).alias("stockout_days"),
        count_where(F.col("lost_demand_flag")).alias("lost_demand_days"),
        count_where(F.col("material_lost_demand_flag")).alias("material_lost_demand_days"),
        count_where(F.col("severe_lost_demand_flag")).alias("severe_lost_demand_days"),
        F.sum("demand_opportunity").alias("total_demand_opportunity"),
    ]


def _loss_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "overall_lost_demand_rate": share("total_estimated_lost_demand", "total_deconstrained_demand", 0.0),
        "fulfillment_rate": share("total_observed_sales", "total_deconstrained_demand", 1.0),
    })


def aggregate_loss(df: DataFrame, keys: list[str]) -> DataFrame:
    """Loss totals for any grouping; a NULL key is a group of its own."""
    return loss_metrics(df).groupBy(*keys).agg(*_loss_measures()).transform(_loss_rates)


def loss_rollups(df: DataFrame) -> DataFrame:
    """Per outlet, per product and per pair from one pass (grouping sets)."""
    pair, outlet, product = (["outlet_id", "product_id"], ["outlet_id"], ["product_id"])
    level = (F.when(F.grouping("product_id") == 1, "outlet")
              .when(F.grouping("outlet_id") == 1, "product").otherwise("pair"))
    sets = [[F.col(c) for c in keys] for keys in (pair, outlet, product)]
    return (loss_metrics(df)
            .groupingSets(sets, "outlet_id", "product_id")
            .agg(level.alias("level"), *_loss_measures())
            .transform(_loss_rates))


def loss_patterns(df: DataFrame) -> DataFrame:
    """Recurrence and persistence of loss, from the days before the current one."""
    require_columns(df, [*DAY_KEY, "estimated_lost_demand", "lost_demand_rate", "stockout"], "loss_patterns")
    df = df.withColumns({
        "_out_before": F.coalesce(lagged(F.col("stockout").cast("double")), F.lit(0.0)),
        "_lost_before": F.coalesce(lagged("estimated_lost_demand"), F.lit(0.0)),
    })
    df = df.withColumns({
        "lost_demand_7d": rolling("estimated_lost_demand", 7, F.sum, 1),
        "lost_demand_28d": rolling("estimated_lost_demand", 28, F.sum, 1),
        "lost_demand_rate_7d": rolling("lost_demand_rate", 7, F.avg, 1),
        # Yesterday's state is 0 on a series' first day, so the sum starts there.
        "stockout_days_7d": rolling("_out_before", 7, F.sum, 1, include_today=True),
        "stockout_days_28d": rolling("_out_before", 28, F.sum, 1, include_today=True),
    })
    return df.withColumns({
        "loss_event_start": (F.col("estimated_lost_demand") > 0) & ~(F.col("_lost_before") > 0),
        "recurring_loss_flag": flag((F.col("lost_demand_28d") > 0) & (F.col("stockout_days_28d") >= 2)),
        "persistent_loss_flag": F.col("stockout_days_7d") >= 3,
        "loss_acceleration":
            F.coalesce(ratio("lost_demand_7d", F.col("lost_demand_28d") / 4.0), F.lit(1.0)),
    }).drop("_out_before", "_lost_before")


def loss_severity(df: DataFrame) -> DataFrame:
    rate, recent, days = (F.coalesce(F.col(c), F.lit(0.0))
                          for c in ("lost_demand_rate", "lost_demand_7d", "stockout_days_7d"))
    return df.withColumn("loss_severity", first_rule([
        ((rate >= 0.50) | (days >= 5), "critical"),
        ((rate >= 0.25) | (days >= 3), "high"),
        ((rate >= 0.10) | (recent > 0), "moderate"),
    ], "low"))


def loss_priority(df: DataFrame, rank: bool = True) -> DataFrame:
    """Priority score, band and, on request, the dense rank over the whole table."""
    lost = F.greatest(F.coalesce(F.col("estimated_lost_demand"), F.lit(0.0)), F.lit(0.0))
    rate = clip(F.coalesce(F.col("lost_demand_rate"), F.lit(0.0)), 0.0, 1.0)
    recurrence = F.coalesce(column_or(df, "stockout_days_28d", 0.0), F.lit(0.0))
    acceleration = clip(F.coalesce(column_or(df, "loss_acceleration", 1.0), F.lit(1.0)), 0.0, 10.0)
    severity = column_or(df, "loss_severity", "low")
    weight = F.coalesce(*[F.when(severity == k, w) for k, w in SEVERITY_WEIGHT.items()], F.lit(1.0))
    score = (F.log1p(lost) * (1.0 + rate * 10.0) * (1.0 + F.least(recurrence, F.lit(28.0)) / 7.0)
             * (0.5 + F.least(acceleration, F.lit(4.0))) * weight)
    df = df.withColumn("priority_score", score)
    df = df.withColumn("priority_band", first_rule([
        (F.col("priority_score") >= 50, "critical"),
        (F.col("priority_score") >= 20, "high"),
        (F.col("priority_score") >= 5, "medium"),
    ], "low"))
    return dense_rank_all(df, "priority_score", "priority_rank") if rank else df


def loss_analysis(df: DataFrame, rank: bool = True) -> DataFrame:
    return (df.transform(loss_metrics).transform(loss_patterns)
              .transform(loss_severity).transform(loss_priority, rank))


def top_opportunities(df: DataFrame, limit: int = 20) -> DataFrame:
    """Highest priority scores; the global rank is not needed to find them."""
    return (loss_analysis(df, rank=False)
            .orderBy(F.desc(F.round("priority_score", 9)), *DAY_KEY).limit(limit))

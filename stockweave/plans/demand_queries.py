"""Queries: true demand, stockouts, censoring, lost demand, spikes, cultural context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cultural, lost_demand, spikes, stockout
from ..sources import demand_tables as src
from .feature_queries import KEY, with_context
from .lineage import cut
from .oracle_parts import SERIES, clip, lag, roll, expand
from .registry import cte, query


def stock(spark, sf):
    """Sales and inventory. Both come from the line items, which are scanned once and stored."""
    facts = cut(src.daily_facts(spark, sf))
    return src.sales(facts), src.inventory(facts)


def demand(spark, sf):
    return stockout.deconstrain(*stock(spark, sf))


def demand_of(facts):
    """`demand` from facts that are already there."""
    return stockout.deconstrain(src.sales(facts), src.inventory(facts))


# --- true demand -----------------------------------------------------------------------------

cte("true_demand", f"""
SELECT *, true_demand - quantity_sold AS lost_demand,
  CASE WHEN true_demand > 0 THEN least(greatest(quantity_sold / true_demand, 0.0), 1.0) ELSE 1.0 END AS fulfillment_rate,
  true_demand > quantity_sold AS demand_constrained
FROM (SELECT *, CASE WHEN stockout THEN greatest(quantity_sold, historical_demand_estimate)
        ELSE quantity_sold END AS true_demand
      FROM (SELECT *, coalesce({roll("quantity_sold", 28, "avg", 7)}, quantity_sold) AS historical_demand_estimate
            FROM stocked) a) b
""", "stocked")


@query("true_demand", f"{KEY} historical_demand_estimate:6 true_demand:6 lost_demand:6 fulfillment_rate:6 "
       "demand_constrained:b", "SELECT * FROM true_demand", "true_demand")
def _(spark, sf):
    return stockout.estimate_true_demand(*stock(spark, sf))


@query("true_demand_summary", "records:i true_demand:4 observed_sales:4 lost_demand:4 stockout_records:i "
       "stockout_rate:6 overall_fulfillment_rate:6", """
SELECT count(*) AS records, sum(true_demand) AS true_demand, sum(quantity_sold) AS observed_sales,
  sum(lost_demand) AS lost_demand, count(*) FILTER (stockout) AS stockout_records,
  count(*) FILTER (stockout) / count(*) AS stockout_rate,
  sum(quantity_sold) / sum(true_demand) AS overall_fulfillment_rate
FROM true_demand""", "true_demand")
def _(spark, sf):
    return stockout.demand_summary(stockout.estimate_true_demand(*stock(spark, sf)))


# --- reconstruction ----------------------------------------------------------------------------

cte("signals", f"""
SELECT *, stockout AND NOT previous_stockout AS stockout_start,
  CASE WHEN stockout THEN row_number() OVER (PARTITION BY outlet_id, product_id, run ORDER BY date)
       - (CASE WHEN run > 0 THEN 1 ELSE 0 END) ELSE 0 END AS stockout_duration,
  NOT stockout AND previous_stockout AS post_stockout_recovery
FROM (SELECT *, coalesce({lag("stockout")}, false) AS previous_stockout,
        sum(CASE WHEN stockout THEN 0 ELSE 1 END) OVER ({SERIES}) AS run
      FROM stocked) a
""", "stocked")


@query("stockout_signals", f"{KEY} stockout:b previous_stockout:b stockout_start:b stockout_duration:i "
       "post_stockout_recovery:b", "SELECT * FROM signals", "signals")
def _(spark, sf):
    return stockout.stockout_signals(*stock(spark, sf))


DOW = "PARTITION BY outlet_id, product_id, isodow(date) ORDER BY date"
cte("clean", f"""
SELECT *, {roll("clean_sales", 56, "avg", 7)} AS recent_clean_mean,
  {roll("clean_sales", 56, "median", 7)} AS recent_clean_median,
  {expand("clean_sales", "avg", 7)} AS all_clean_mean,
  ({expand("clean_sales", "sum", 1, over=DOW)})
    / nullif(count(clean_sales) OVER ({DOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dow_clean_mean
FROM (SELECT *, CASE WHEN NOT stockout THEN quantity_sold END AS clean_sales FROM signals) a
""", "signals")


@query("clean_reference", f"{KEY} recent_clean_mean:6 recent_clean_median:6 all_clean_mean:6 dow_clean_mean:6",
       "SELECT * FROM clean", "clean")
def _(spark, sf):
    return stockout.clean_reference(stockout.stockout_signals(*stock(spark, sf)))


cte("decon", """
SELECT *, greatest(deconstrained_demand - quantity_sold, 0.0) AS estimated_lost_demand,
  CASE WHEN deconstrained_demand > 0
    THEN least(greatest(quantity_sold / deconstrained_demand, 0.0), 1.0) ELSE 1.0 END AS estimated_fulfillment_rate,
  deconstrained_demand > quantity_sold AS demand_constrained_estimated
FROM (
  SELECT *, greatest(CASE WHEN stockout THEN greatest(quantity_sold, reference
      * least(1.0 + 0.025 * greatest(stockout_duration - 1.0, 0.0), 1.1)) ELSE quantity_sold END, 0.0)
    AS deconstrained_demand
  FROM (
    SELECT *, CASE WHEN known >= 2 THEN 0.45 * coalesce(recent_clean_mean, row_mean)
        + 0.25 * coalesce(recent_clean_median, row_mean) + 0.20 * coalesce(dow_clean_mean, row_mean)
        + 0.10 * coalesce(all_clean_mean, row_mean)
      ELSE coalesce(recent_clean_mean, recent_clean_median, dow_clean_mean, all_clean_mean, quantity_sold)
      END AS reference
    FROM (
      SELECT *, list_avg([recent_clean_mean, recent_clean_median, dow_clean_mean, all_clean_mean]) AS row_mean,
        len(list_filter([recent_clean_mean, recent_clean_median, dow_clean_mean, all_clean_mean],
                        lambda x: x IS NOT NULL)) AS known
      FROM clean) a) b) c
""", "clean")


@query("deconstrained_demand", f"{KEY} quantity_sold:6 closing_stock:6 stockout:b stockout_duration:i "
       "deconstrained_demand:6 estimated_lost_demand:6 estimated_fulfillment_rate:6 "
       "demand_constrained_estimated:b", "SELECT * FROM decon", "decon")
def _(spark, sf):
    return demand(spark, sf)


# --- censoring ---------------------------------------------------------------------------------

cte("events_in_series", f"""
SELECT *, CASE WHEN stockout THEN row_number() OVER (PARTITION BY outlet_id, product_id, stockout_event_id
    ORDER BY date) ELSE 0 END AS stockout_event_day
FROM (SELECT *, CASE WHEN stockout THEN sum(CAST(stockout_start AS INTEGER)) OVER ({SERIES}) ELSE 0 END
        AS stockout_event_id FROM decon) a
""", "decon")


@query("stockout_events", f"{KEY} stockout_event_start:b stockout_event_id:i stockout_event_active:b "
       "stockout_event_day:i", """
SELECT *, stockout_start AS stockout_event_start, stockout_event_id > 0 AS stockout_event_active
FROM events_in_series""", "events_in_series")
def _(spark, sf):
    return stockout.stockout_events(demand(spark, sf))


STRENGTH = (f"0.50 * censoring_ratio + 0.30 * least(greatest(estimated_lost_demand / d, 0.0), 1.0) "
            f"+ 0.20 * least(greatest(pressure - 1.0, 0.0), 1.0)")
cte("censored", f"""
SELECT *, CASE WHEN NOT stockout THEN 'not_censored' WHEN censoring_strength >= 0.75 THEN 'strong'
  WHEN censoring_strength >= 0.50 THEN 'moderate' WHEN censoring_strength >= 0.25 THEN 'weak'
  ELSE 'minimal' END AS censoring_class
FROM (
  SELECT *, stockout AND (estimated_lost_demand > 0 OR censoring_ratio > 0) AS censored_demand_flag,
    CASE WHEN stockout THEN least(greatest({STRENGTH}, 0.0), 1.0) ELSE 0.0 END AS censoring_strength
  FROM (
    SELECT *, greatest(deconstrained_demand, 1e-9) AS d,
      greatest(deconstrained_demand - quantity_sold, 0.0) AS sales_demand_gap,
      least(greatest(greatest(deconstrained_demand - quantity_sold, 0.0) / greatest(deconstrained_demand, 1e-9), 0.0), 1.0)
        AS censoring_ratio,
      coalesce({clip("pre_stockout_demand / (CASE WHEN pre_stockout_sales IS NOT NULL THEN greatest(pre_stockout_sales, 1e-9) END)", 0.0, 5.0)}, 1.0) AS pressure
    FROM (SELECT *, {roll("deconstrained_demand", 7, "avg", 1)} AS pre_stockout_demand,
            {roll("quantity_sold", 7, "avg", 1)} AS pre_stockout_sales
          FROM events_in_series) a) b) c
""", "events_in_series")


@query("censoring_signals", f"{KEY} pre_stockout_demand:6 pre_stockout_sales:6 sales_demand_gap:6 "
       "censoring_ratio:6 pre_stockout_demand_pressure:6 censored_demand_flag:b censoring_strength:6 "
       "censoring_class", "SELECT *, pressure AS pre_stockout_demand_pressure FROM censored", "censored")
def _(spark, sf):
    return stockout.classify_censoring(stockout.censoring_signals(demand(spark, sf)))


cte("recovered", f"""
SELECT *, recovery_event AND recovery_ratio > 1.1 AS post_stockout_recovery_flag,
  CASE WHEN recovery_event THEN least(greatest(recovery_ratio - 1.0, 0.0), 1.0) ELSE 0.0 END AS recovery_strength,
  row_number() OVER (PARTITION BY outlet_id, product_id, state ORDER BY date) - 1 AS days_since_stockout
FROM (
  SELECT *, coalesce({clip("deconstrained_demand / (CASE WHEN ref IS NOT NULL THEN greatest(ref, 1e-9) END)", 0.0, 5.0)}, 1.0)
      AS recovery_ratio,
    sum(CAST(changed AS INTEGER)) OVER ({SERIES}) AS state
  FROM (
    SELECT *, {roll("cd", 7, "median", 1)} AS ref
    FROM (SELECT *, previous_stockout AND NOT stockout AS recovery_event,
            CASE WHEN NOT stockout THEN deconstrained_demand END AS cd,
            coalesce({lag("stockout")} <> stockout, true) AS changed
          FROM censored) a) b) c
""", "censored")


@query("stockout_recovery", f"{KEY} recovery_event:b days_since_stockout:i clean_reference_demand:6 "
       "recovery_ratio:6 post_stockout_recovery_flag:b recovery_strength:6",
       "SELECT *, ref AS clean_reference_demand FROM recovered", "recovered")
def _(spark, sf):
    return stockout.stockout_recovery(demand(spark, sf))


@query("censoring_analysis", f"{KEY} stockout_event_id:i censoring_strength:6 censoring_class "
       "censored_demand_flag:b recovery_event:b recovery_ratio:6", "SELECT * FROM recovered", "recovered")
def _(spark, sf):
    return stockout.censoring_analysis(demand(spark, sf))


EVENT_SQL = """
  min(date) AS event_start, max(date) AS event_end, count(*) AS event_duration_days,
  sum(estimated_lost_demand) AS event_lost_demand, sum(deconstrained_demand) AS event_demand,
  sum(quantity_sold) AS event_sales,
  least(greatest(sum(estimated_lost_demand) / greatest(sum(deconstrained_demand), 1e-9), 0.0), 1.0) AS event_loss_rate,
  least(greatest(sum(quantity_sold) / greatest(sum(deconstrained_demand), 1e-9), 0.0), 1.0) AS event_fulfillment_rate"""
EVENT_SPEC = ("outlet_id product_id stockout_event_id:i event_start:d event_end:d event_duration_days:i "
              "event_lost_demand:6 event_demand:6 event_sales:6 event_loss_rate:6 event_fulfillment_rate:6")


@query("stockout_event_summary", EVENT_SPEC, f"""
SELECT outlet_id, product_id, stockout_event_id, {EVENT_SQL}
FROM events_in_series WHERE stockout GROUP BY 1, 2, 3""", "events_in_series")
def _(spark, sf):
    return stockout.event_summary(demand(spark, sf))


@query("censoring_event_summary", EVENT_SPEC + " average_censoring_strength:6 max_censoring_strength:6 "
       "strong_censoring_days:i moderate_censoring_days:i", f"""
SELECT outlet_id, product_id, stockout_event_id, {EVENT_SQL},
  avg(censoring_strength) AS average_censoring_strength, max(censoring_strength) AS max_censoring_strength,
  count(*) FILTER (censoring_class = 'strong') AS strong_censoring_days,
  count(*) FILTER (censoring_class = 'moderate') AS moderate_censoring_days
FROM censored WHERE stockout GROUP BY 1, 2, 3""", "censored")
def _(spark, sf):
    return stockout.censoring_event_summary(demand(spark, sf))


ROLLUP_SQL = """count(*) AS records, count(*) FILTER (stockout) AS stockout_days,
  count(*) FILTER (censored_demand_flag) AS censored_days,
  avg(censoring_strength) AS average_censoring_strength,
  count(*) FILTER (censoring_class = 'strong') AS strong_censoring_days,
  count(*) FILTER (recovery_event) AS recovery_events,
  count(*) FILTER (post_stockout_recovery_flag) AS strong_recovery_events"""
ROLLUP_SPEC = "records:i stockout_days:i censored_days:i average_censoring_strength:6 strong_censoring_days:i recovery_events:i"


@query("censoring_outlets", f"outlet_id {ROLLUP_SPEC} strong_recovery_events:i",
       f"SELECT outlet_id, {ROLLUP_SQL} FROM recovered GROUP BY 1", "recovered")
def _(spark, sf):
    return stockout.censoring_rollup(demand(spark, sf), "outlet_id")


@query("censoring_products", f"product_id {ROLLUP_SPEC}",
       f"SELECT product_id, {ROLLUP_SQL} FROM recovered GROUP BY 1", "recovered")
def _(spark, sf):
    return stockout.censoring_rollup(demand(spark, sf), "product_id")


@query("recovery_summary", "outlet_id product_id recovery_events:i strong_recovery_events:i "
       "average_recovery_ratio:6 max_recovery_ratio:6", """
SELECT outlet_id, product_id, count(*) AS recovery_events,
  count(*) FILTER (post_stockout_recovery_flag) AS strong_recovery_events,
  avg(recovery_ratio) AS average_recovery_ratio, max(recovery_ratio) AS max_recovery_ratio
FROM recovered WHERE recovery_event GROUP BY 1, 2""", "recovered")
def _(spark, sf):
    return stockout.recovery_summary(stockout.stockout_recovery(demand(spark, sf)))


@query("top_censored", f"{KEY} censoring_priority:6", """
SELECT *, estimated_lost_demand * (1.0 + censoring_strength) * (1.0 + stockout_event_day / 7.0) AS censoring_priority
FROM censored WHERE censored_demand_flag
ORDER BY round(estimated_lost_demand * (1.0 + censoring_strength) * (1.0 + stockout_event_day / 7.0), 9) DESC,
  outlet_id, product_id, date LIMIT 20""", "censored")
def _(spark, sf):
    return stockout.top_censored(demand(spark, sf))


# --- lost demand ---------------------------------------------------------------------------------

cte("loss", """
SELECT *, lost_demand_rate >= 0.1 AS material_lost_demand_flag, lost_demand_rate >= 0.25 AS severe_lost_demand_flag,
  estimated_lost_demand * lost_demand_rate AS lost_demand_value_index, estimated_lost_demand > 0 AS lost_demand_flag
FROM (
  SELECT outlet_id, product_id, date, stockout, quantity_sold, deconstrained_demand,
    greatest(estimated_lost_demand, deconstrained_demand - quantity_sold) AS estimated_lost_demand,
    CASE WHEN deconstrained_demand > 0 THEN least(greatest(greatest(estimated_lost_demand,
      deconstrained_demand - quantity_sold) / deconstrained_demand, 0.0), 1.0) ELSE 0.0 END AS lost_demand_rate,
    CASE WHEN deconstrained_demand > 0 THEN least(greatest(quantity_sold / deconstrained_demand, 0.0), 1.0)
      ELSE 1.0 END AS realized_demand_rate
  FROM decon) a
""", "decon")


@query("loss_metrics", f"{KEY} estimated_lost_demand:6 lost_demand_rate:6 realized_demand_rate:6 "
       "lost_demand_flag:b material_lost_demand_flag:b severe_lost_demand_flag:b lost_demand_value_index:6",
       "SELECT * FROM loss", "loss")
def _(spark, sf):
    return lost_demand.loss_metrics(demand(spark, sf))


LOSS_TOTALS = """sum(quantity_sold) AS total_observed_sales, sum(deconstrained_demand) AS total_deconstrained_demand,
  sum(estimated_lost_demand) AS total_estimated_lost_demand, avg(lost_demand_rate) AS average_lost_demand_rate,
  count(*) FILTER (stockout) AS stockout_days, count(*) FILTER (lost_demand_flag) AS lost_demand_days,
  count(*) FILTER (material_lost_demand_flag) AS material_lost_demand_days,
  count(*) FILTER (severe_lost_demand_flag) AS severe_lost_demand_days,
  sum(deconstrained_demand) AS total_demand_opportunity,
  CASE WHEN sum(deconstrained_demand) > 0 THEN least(greatest(sum(estimated_lost_demand) / sum(deconstrained_demand), 0.0), 1.0)
    ELSE 0.0 END AS overall_lost_demand_rate,
  CASE WHEN sum(deconstrained_demand) > 0 THEN least(greatest(sum(quantity_sold) / sum(deconstrained_demand), 0.0), 1.0)
    ELSE 1.0 END AS fulfillment_rate"""
LOSS_SPEC = ("total_observed_sales:4 total_deconstrained_demand:4 total_estimated_lost_demand:4 "
             "average_lost_demand_rate:6 stockout_days:i lost_demand_days:i material_lost_demand_days:i "
             "severe_lost_demand_days:i total_demand_opportunity:4 overall_lost_demand_rate:6 fulfillment_rate:6")


def _loss_by(name: str, keys: list[str]):
    @query(name, f"{' '.join(keys)} {LOSS_SPEC}",
           f"SELECT {', '.join(keys)}, {LOSS_TOTALS} FROM loss GROUP BY {', '.join(keys)}", "loss")
    def _(spark, sf):
        return lost_demand.aggregate_loss(demand(spark, sf), keys)


_loss_by("loss_outlets", ["outlet_id"])
_loss_by("loss_products", ["product_id"])
_loss_by("loss_pairs", ["outlet_id", "product_id"])


@query("loss_rollups", f"level outlet_id product_id {LOSS_SPEC}", f"""
SELECT CASE WHEN grouping(product_id) = 1 THEN 'outlet' WHEN grouping(outlet_id) = 1 THEN 'product' ELSE 'pair' END AS level,
  coalesce(outlet_id, '-') AS outlet_id, coalesce(product_id, '-') AS product_id, {LOSS_TOTALS}
FROM loss GROUP BY GROUPING SETS ((outlet_id, product_id), (outlet_id), (product_id))""", "loss")
def _(spark, sf):
    rollups = lost_demand.loss_rollups(demand(spark, sf))
    return rollups.withColumns({c: F.coalesce(F.col(c), F.lit("-")) for c in ("outlet_id", "product_id")})


cte("pattern", f"""
SELECT *, estimated_lost_demand > 0 AND NOT coalesce({lag("estimated_lost_demand")}, 0) > 0 AS loss_event_start,
  coalesce(lost_demand_28d > 0 AND stockout_days_28d >= 2, false) AS recurring_loss_flag,
  stockout_days_7d >= 3 AS persistent_loss_flag,
  coalesce(lost_demand_7d / nullif(lost_demand_28d / 4.0, 0), 1.0) AS loss_acceleration
FROM (
  SELECT *, {roll("estimated_lost_demand", 7, "sum", 1)} AS lost_demand_7d,
    {roll("estimated_lost_demand", 28, "sum", 1)} AS lost_demand_28d,
    {roll("lost_demand_rate", 7, "avg", 1)} AS lost_demand_rate_7d,
    {roll("was_out", 7, "sum", 1, today=True)} AS stockout_days_7d,
    {roll("was_out", 28, "sum", 1, today=True)} AS stockout_days_28d
  FROM (SELECT *, coalesce(CAST({lag("stockout")} AS DOUBLE), 0.0) AS was_out FROM loss) a) b
""", "loss")


@query("loss_patterns", f"{KEY} lost_demand_7d:6 lost_demand_28d:6 lost_demand_rate_7d:6 stockout_days_7d:6 "
       "stockout_days_28d:6 loss_event_start:b recurring_loss_flag:b persistent_loss_flag:b loss_acceleration:6",
       "SELECT * FROM pattern", "pattern")
def _(spark, sf):
    return lost_demand.loss_patterns(lost_demand.loss_metrics(demand(spark, sf)))


cte("priority", """
SELECT *, CASE WHEN priority_score >= 50 THEN 'critical' WHEN priority_score >= 20 THEN 'high'
  WHEN priority_score >= 5 THEN 'medium' ELSE 'low' END AS priority_band
FROM (
  SELECT *, ln(1 + estimated_lost_demand) * (1 + 10 * lost_demand_rate) * (1 + least(stockout_days_28d, 28) / 7)
    * (0.5 + least(least(greatest(loss_acceleration, 0.0), 10.0), 4.0))
    * CASE loss_severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.5 WHEN 'moderate' THEN 1.5 ELSE 1.0 END AS priority_score
  FROM (SELECT *, CASE WHEN lost_demand_rate >= 0.5 OR stockout_days_7d >= 5 THEN 'critical'
          WHEN lost_demand_rate >= 0.25 OR stockout_days_7d >= 3 THEN 'high'
          WHEN lost_demand_rate >= 0.1 OR lost_demand_7d > 0 THEN 'moderate' ELSE 'low' END AS loss_severity
        FROM pattern) a) b
""", "pattern")


@query("loss_priority", f"{KEY} loss_severity priority_score:6 priority_band", "SELECT * FROM priority", "priority")
def _(spark, sf):
    return lost_demand.loss_analysis(demand(spark, sf), rank=False)


# Scores of two engines differ in the last bits, so the oracle ranks rounded ones.
@query("loss_rank", f"{KEY} score:6 priority_rank:i", """
SELECT *, round(priority_score, 6) AS score, dense_rank() OVER (ORDER BY round(priority_score, 6) DESC) AS priority_rank
FROM priority""", "priority")
def _(spark, sf):
    scored = lost_demand.loss_analysis(demand(spark, sf), rank=False)
    scored = scored.withColumn("score", F.round("priority_score", 6))
    return lost_demand.dense_rank_all(scored, "score", "priority_rank")


@query("top_opportunities", f"{KEY} priority_score:6", """
SELECT * FROM priority ORDER BY round(priority_score, 9) DESC, outlet_id, product_id, date LIMIT 20""", "priority")
def _(spark, sf):
    return lost_demand.top_opportunities(demand(spark, sf))


# --- spikes ----------------------------------------------------------------------------------------

cte("spike_base", f"""
SELECT *, coalesce(m, med) AS b, n >= 7 AS spike_history_ready, quantity_sold - m AS lift,
  quantity_sold / (abs(m) + 1e-6) AS spike_ratio, (quantity_sold - m) / (abs(m) + 1e-6) AS spike_percentage_lift,
  (quantity_sold - m) / (abs(s) + 1e-6) AS spike_z_score,
  abs(quantity_sold - m) / (abs(coalesce(s, 0.0)) + 1e-6) AS spike_robust_score
FROM (SELECT *, {roll("quantity_sold", 28, "avg", 7, True)} AS m, {roll("quantity_sold", 28, "stddev_samp", 7, True)} AS s,
        {roll("quantity_sold", 28, "median", 7, True)} AS med, {roll("quantity_sold", 28, "count", 0, True)} AS n
      FROM active_context) a
""", "active_context")
cte("spike_found", f"""
SELECT *, coalesce(spike_history_ready AND lift > 0 AND spike_ratio >= 1.5 AND spike_z_score >= 2.0, false) AS is_demand_spike,
  {clip(f"0.5 * {clip('spike_ratio - 1.0', 0, 3)} + 0.5 * {clip('spike_z_score / 4.0', 0, 3)}", 0, 3)} AS spike_score,
  CASE WHEN lift > 0 THEN 'above_baseline' WHEN lift < 0 THEN 'below_baseline' ELSE 'at_baseline' END
    AS demand_deviation_direction
FROM spike_base
""", "spike_base")


def spike_input(spark, sf):
    """Stored, because the drivers read it for two quantiles before the main pass."""
    return cut(with_context(spark, sf))


@query("spike_detection", f"{KEY} spike_baseline_mean:6 spike_baseline_std:6 spike_baseline_median:6 "
       "spike_history_count:i spike_baseline:6 spike_absolute_lift:6 spike_ratio:6 spike_percentage_lift:6 "
       "spike_z_score:5 spike_robust_score:5 spike_history_ready:b is_demand_spike:b spike_score:6 "
       "demand_deviation_direction", """
SELECT *, m AS spike_baseline_mean, s AS spike_baseline_std, med AS spike_baseline_median,
  n AS spike_history_count, b AS spike_baseline, lift AS spike_absolute_lift FROM spike_found""", "spike_found")
def _(spark, sf):
    return spikes.detect_spikes(with_context(spark, sf))


cte("spike_severe", """
SELECT *, CASE WHEN is_demand_spike AND (spike_score >= 2 OR spike_ratio >= 3 OR spike_z_score >= 5) THEN 'extreme'
    WHEN is_demand_spike AND (spike_score >= 1.25 OR spike_ratio >= 2 OR spike_z_score >= 3) THEN 'major'
    WHEN is_demand_spike THEN 'moderate' ELSE 'none' END AS spike_severity
FROM spike_found""", "spike_found")


@query("spike_severity", f"{KEY} spike_severity spike_severity_score:i spike_priority", """
SELECT *, CASE spike_severity WHEN 'extreme' THEN 3 WHEN 'major' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END AS spike_severity_score,
  CASE spike_severity WHEN 'extreme' THEN 'critical' WHEN 'major' THEN 'high' WHEN 'moderate' THEN 'watch'
    ELSE 'normal' END AS spike_priority
FROM spike_severe""", "spike_severe")
def _(spark, sf):
    return spikes.spike_severity(spikes.detect_spikes(with_context(spark, sf)))


cte("spike_driven", """
SELECT *, CASE WHEN NOT is_demand_spike THEN 'none' WHEN signals >= 2 THEN 'multiple_contexts'
    WHEN signals = 1 THEN 'single_context' WHEN extreme THEN 'weather_temperature' ELSE 'unexplained' END AS spike_driver_class
FROM (
  SELECT *, CASE WHEN is_demand_spike THEN holiday_active + promotion_active + CAST(event_active AS INTEGER) + is_rainy
      ELSE 0 END AS signals,
    (holiday_active + promotion_active + event_active + is_rainy) / 4.0 AS spike_context_intensity,
    CASE WHEN holiday_active > 0 THEN 'holiday' WHEN promotion_active > 0 THEN 'promotion'
      WHEN event_active > 0 THEN 'event' WHEN is_rainy > 0 THEN 'weather' ELSE 'none' END AS spike_primary_context,
    temperature <= (SELECT quantile_cont(temperature, 0.1) FROM spike_severe)
      OR temperature >= (SELECT quantile_cont(temperature, 0.9) FROM spike_severe) AS extreme
  FROM spike_severe) a""", "spike_severe")


@query("spike_drivers", f"{KEY} spike_context_signal_count:i spike_context_intensity:6 spike_primary_context "
       "spike_multi_context:b spike_temperature_extreme:b spike_driver_class", """
SELECT *, signals AS spike_context_signal_count, signals >= 2 AS spike_multi_context,
  extreme AS spike_temperature_extreme FROM spike_driven""", "spike_driven")
def _(spark, sf):
    return spikes.spike_drivers(spikes.spike_severity(spikes.detect_spikes(spike_input(spark, sf))))


cte("spike_runs", f"""
SELECT *, CASE WHEN NOT is_demand_spike THEN 'normal' WHEN length >= 3 THEN 'persistent' WHEN length = 2 THEN 'repeated'
    ELSE 'isolated' END AS spike_pattern, NOT is_demand_spike AND was AS spike_recovery_day
FROM (
  SELECT *, CASE WHEN is_demand_spike THEN count(*) OVER (PARTITION BY outlet_id, product_id, episode) ELSE 0 END AS length
  FROM (
    SELECT *, CASE WHEN is_demand_spike THEN sum(CASE WHEN is_demand_spike AND NOT was THEN 1 ELSE 0 END) OVER ({SERIES})
        ELSE 0 END AS episode,
      date - max(CASE WHEN is_demand_spike THEN date END) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS days_since_previous_spike,
      is_demand_spike AND coalesce(lead(is_demand_spike) OVER ({SERIES}), false) AS spike_followed_by_spike
    FROM (SELECT *, coalesce({lag("is_demand_spike")}, false) AS was FROM spike_driven) a) b) c""", "spike_driven")


@query("spike_persistence", f"{KEY} days_since_previous_spike:6 spike_episode_id:i spike_episode_length:i "
       "spike_pattern spike_recovery_day:b spike_followed_by_spike:b post_spike_demand_ratio:6", """
SELECT *, episode AS spike_episode_id, length AS spike_episode_length, spike_ratio AS post_spike_demand_ratio
FROM spike_runs""", "spike_runs")
def _(spark, sf):
    return spikes.spike_persistence(spikes.detect_spikes(with_context(spark, sf)))


@query("spike_analysis", f"{KEY} is_demand_spike:b spike_score:6 spike_severity spike_driver_class spike_pattern",
       "SELECT * FROM spike_runs", "spike_runs")
def _(spark, sf):
    return spikes.spike_analysis(spike_input(spark, sf))


@query("spike_summary", "rows:i spikes:i spike_rate:6 moderate_spikes:i major_spikes:i extreme_spikes:i "
       "persistent_spikes:i repeated_spikes:i isolated_spikes:i recovery_days:i", """
SELECT count(*) AS rows, count(*) FILTER (is_demand_spike) AS spikes,
  count(*) FILTER (is_demand_spike) / count(*) AS spike_rate,
  count(*) FILTER (spike_severity = 'moderate') AS moderate_spikes,
  count(*) FILTER (spike_severity = 'major') AS major_spikes,
  count(*) FILTER (spike_severity = 'extreme') AS extreme_spikes,
  count(*) FILTER (spike_pattern = 'persistent') AS persistent_spikes,
  count(*) FILTER (spike_pattern = 'repeated') AS repeated_spikes,
  count(*) FILTER (spike_pattern = 'isolated') AS isolated_spikes,
  count(*) FILTER (spike_recovery_day) AS recovery_days
FROM spike_runs""", "spike_runs")
def _(spark, sf):
    return spikes.spike_summary(spikes.spike_analysis(spike_input(spark, sf)))


# --- cultural context ---------------------------------------------------------------------------------

def cultural_inputs(spark, sf):
    facts = cut(src.daily_facts(spark, sf))
    return (facts.select("outlet_id", "product_id", "date", F.col("quantity_sold").alias("demand")),
            cultural.prepare_calendar(src.calendar_days(facts)),
            cultural.prepare_demographics(src.demographics(src.outlets(spark, sf))))


@query("calendar_context", "outlet_id date:d holiday_importance:6 religious_importance:6 event_importance:6 "
       "holiday_active:i religious_period_active:i event_active:i", """
SELECT *, CAST(holiday_importance > 0 AS INTEGER) AS holiday_active,
  CAST(religious_importance > 0 AS INTEGER) AS religious_period_active,
  CAST(event_importance > 0 AS INTEGER) AS event_active FROM calendar_days""", "calendar_days")
def _(spark, sf):
    return cultural.prepare_calendar(src.calendar_days(src.daily_facts(spark, sf)))


@query("demographic_context", "outlet_id population_density:6 tourism_index:6 student_index:6 business_index:6 "
       "residential_index:6 religious_population_share:6 young_population_share:6 working_population_share:6 "
       "dominant_religious_context demographic_context city_class", """
SELECT *, 'unknown' AS dominant_religious_context, 'unknown' AS demographic_context, 'unknown' AS city_class
FROM demographics""", "demographics")
def _(spark, sf):
    return cultural.prepare_demographics(src.demographics(src.outlets(spark, sf)))


cte("cultural", f"""
SELECT *, greatest(reference, 0.0) * score AS cultural_demand_pressure
FROM (
  SELECT *, {clip("0.40 * religious_importance * religious_population_share + 0.25 * holiday_importance + 0.20 * event_importance + 0.15 * tourism_index * holiday_importance", 0, 1)} AS score,
    coalesce({roll("quantity_sold", 28, "avg", 7)}, {lag("quantity_sold")}, quantity_sold) AS reference
  FROM facts LEFT JOIN (SELECT outlet_id, date, holiday_importance, religious_importance, event_importance
                        FROM calendar_days) c USING (outlet_id, date)
  LEFT JOIN demographics USING (outlet_id)) a""", "facts", "calendar_days", "demographics")


@query("cultural_effects", f"{KEY} religious_context_exposure:6 tourism_context_exposure:6 student_context_exposure:6 "
       "business_context_exposure:6 working_population_exposure:6 cultural_context_score:6 "
       "historical_demand_reference:6 cultural_demand_pressure:6", """
SELECT *, religious_importance * religious_population_share AS religious_context_exposure,
  tourism_index * holiday_importance AS tourism_context_exposure,
  student_index * holiday_importance AS student_context_exposure,
  business_index * holiday_importance AS business_context_exposure,
  working_population_share * business_index AS working_population_exposure,
  score AS cultural_context_score, reference AS historical_demand_reference FROM cultural""", "cultural")
def _(spark, sf):
    return cultural.cultural_effects(*cultural_inputs(spark, sf))

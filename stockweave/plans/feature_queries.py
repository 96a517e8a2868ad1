"""Queries: calendar, series and context features."""

from __future__ import annotations

from ..operators import calendar, cultural, series
from ..sources import demand_tables as src
from .oracle_parts import SERIES, columns, expand, lag, roll
from .registry import cte, query

KEY = "outlet_id product_id date:d"
Q = "quantity_sold"


def spec(names, digits: int = 6, head: str = KEY) -> str:
    return " ".join([head, *(f"{n}:{digits}" for n in names)])


@query("facts_daily", f"{KEY} quantity_sold:6 revenue:4 discount:4 received_stock:6 closing_stock:6",
       "SELECT * FROM facts", "facts")
def _(spark, sf):
    return src.daily_facts(spark, sf)


DATE_PARTS = {
    "year": "year(date)", "month": "month(date)", "day": "day(date)", "day_of_week": "isodow(date) - 1",
    "week_of_year": "weekofyear(date)", "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
}
TIME_PARTS = DATE_PARTS | {
    "day_of_year": "dayofyear(date)", "quarter": "quarter(date)",
    "dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
    "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)",
}
SEASON = {
    "dow_sin_2": "sin(4 * pi() * (isodow(date) - 1) / 7)", "dow_cos_2": "cos(4 * pi() * (isodow(date) - 1) / 7)",
    "month_sin_2": "sin(4 * pi() * (month(date) - 1) / 12)", "month_cos_2": "cos(4 * pi() * (month(date) - 1) / 12)",
    "quarter_sin": "sin(2 * pi() * (quarter(date) - 1) / 4)", "quarter_cos": "cos(2 * pi() * (quarter(date) - 1) / 4)",
    "weekend_month_interaction": "CASE WHEN isodow(date) >= 6 THEN month(date) ELSE 0 END",
}


def over_facts(pairs: dict[str, str], base: str = "facts") -> str:
    return f"SELECT outlet_id, product_id, date,\n  {columns(pairs)}\nFROM {base}"


@query("date_features", f"{KEY} year:i month:i day:i day_of_week:i week_of_year:i is_weekend:b",
       over_facts(DATE_PARTS), "facts")
def _(spark, sf):
    return calendar.date_parts(src.daily_facts(spark, sf))


@query("time_features", spec(TIME_PARTS), over_facts(TIME_PARTS), "facts")
def _(spark, sf):
    return calendar.time_features(src.daily_facts(spark, sf))


@query("seasonality_features", spec(SEASON), over_facts(SEASON), "facts")
def _(spark, sf):
    return calendar.seasonality(calendar.time_features(src.daily_facts(spark, sf)))


WE = "CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END"
ADVANCED_TEMPORAL = {
    "advanced_dow_sin_3": "sin(2 * pi() * (isodow(date) - 1) * 3 / 7)",
    "advanced_dow_cos_3": "cos(2 * pi() * (isodow(date) - 1) * 3 / 7)",
    "advanced_month_sin_2": "sin(2 * pi() * month(date) * 2 / 12)",
    "advanced_month_cos_2": "cos(2 * pi() * month(date) * 2 / 12)",
    "advanced_week_sin": "sin(2 * pi() * weekofyear(date) / 52)",
    "advanced_week_cos": "cos(2 * pi() * weekofyear(date) / 52)",
    "advanced_day_year_sin_2": "sin(2 * pi() * dayofyear(date) * 2 / 365)",
    "advanced_day_year_cos_2": "cos(2 * pi() * dayofyear(date) * 2 / 365)",
    "advanced_weekend_month": f"{WE} * month(date)",
    "advanced_weekend_quarter": f"{WE} * quarter(date)",
    "advanced_weekend_year_position": f"{WE} * dayofyear(date) / 365.0",
    "advanced_month_start": "CAST(day(date) = 1 AS INTEGER)",
    "advanced_month_end": "CAST(day(date + 1) = 1 AS INTEGER)",
    "advanced_quarter_start": "CAST(day(date) = 1 AND month(date) % 3 = 1 AS INTEGER)",
    "advanced_quarter_end": "CAST(day(date + 1) = 1 AND month(date) % 3 = 0 AS INTEGER)",
    "advanced_holiday_weekend": f"holiday_active * {WE}",
    "advanced_promotion_weekend": f"promotion_active * {WE}",
    "advanced_event_weekend": f"event_active * {WE}",
    "advanced_holiday_month": "holiday_active * month(date)",
    "advanced_promotion_month": "promotion_active * month(date)",
}

cte("active_context", """
SELECT *, temperature * temperature AS temperature_squared,
  CAST(precipitation > 0 AS INTEGER) AS is_rainy,
  CAST(holiday_importance > 0 AS INTEGER) AS holiday_active,
  CAST(discount > 0 AS INTEGER) AS promotion_active
FROM context_facts
""", "context_facts")


def with_context(spark, sf):
    return calendar.context_features(src.context_facts(src.daily_facts(spark, sf)))


@query("context_features", f"{KEY} temperature_squared:6 is_rainy:i holiday_active:i promotion_active:i",
       "SELECT * FROM active_context", "active_context")
def _(spark, sf):
    return with_context(spark, sf)


@query("advanced_temporal", spec(ADVANCED_TEMPORAL), over_facts(ADVANCED_TEMPORAL, "active_context"),
       "active_context")
def _(spark, sf):
    return calendar.advanced_temporal(with_context(spark, sf))


ADVANCED_CONTEXT = {
    "advanced_temperature_rain": "temperature * is_rainy",
    "advanced_temperature_squared_rain": "temperature_squared * is_rainy",
    "advanced_holiday_rain": "holiday_active * is_rainy",
    "advanced_promotion_rain": "promotion_active * is_rainy",
    "advanced_event_rain": "event_active * is_rainy",
    "advanced_holiday_tourism": "holiday_active * tourism_level * student_area",
    "advanced_event_tourism": "event_active * tourism_level * student_area",
    "advanced_promotion_business": "promotion_active * business_area * capacity",
    "advanced_event_business": "event_active * business_area * capacity",
    "advanced_context_intensity": "holiday_active + promotion_active + event_active + is_rainy",
    "advanced_temperature_abs": "abs(temperature)",
    "advanced_temperature_rain_abs": "abs(temperature) * is_rainy",
}


@query("advanced_context", spec(ADVANCED_CONTEXT),
       over_facts(ADVANCED_CONTEXT, "active_context JOIN outlets USING (outlet_id)"),
       ("active_context", "outlets"))
def _(spark, sf):
    people = src.demographics(src.outlets(spark, sf))
    facts = src.context_facts(src.daily_facts(spark, sf)).join(people, "outlet_id")
    return calendar.advanced_context(calendar.context_features(facts))


# --- series --------------------------------------------------------------------------------

LAGS = {f"lag_{k}": lag(Q, k) for k in series.LAGS}
ROLLING = {f"rolling_{name}_{n}": roll(Q, n, agg) for n in series.WINDOWS
           for name, agg in (("mean", "avg"), ("std", "stddev_samp"))}
TREND = {
    "trend_1d": f"{lag(Q, 1)} - {lag(Q, 2)}",
    "trend_7d": f"{lag(Q, 1)} - {lag(Q, 7)}",
    "trend_14d": f"{lag(Q, 1)} - {lag(Q, 14)}",
    "trend_ratio_7d": f"{lag(Q, 1)} / nullif({lag(Q, 7)}, 0)",
    "trend_ratio_14d": f"{lag(Q, 1)} / nullif({lag(Q, 14)}, 0)",
    "trend_acceleration": f"{lag(Q, 14)} - {lag(Q, 7)}",
}
VOLATILITY = {}
for _n in series.WINDOWS:
    VOLATILITY[f"volatility_{_n}"] = roll(Q, _n, "stddev_samp")
    VOLATILITY[f"coefficient_variation_{_n}"] = f"({roll(Q, _n, 'stddev_samp')}) / nullif({roll(Q, _n)}, 0)"
VELOCITY = {f"order_velocity_{n}d": roll(Q, n) for n in (3, 7, 14)}
VELOCITY["order_velocity_change"] = f"({roll(Q, 3)}) - ({roll(Q, 14)})"


@query("lag_features", spec(LAGS), over_facts(LAGS), "facts")
def _(spark, sf):
    return series.lag_features(src.daily_facts(spark, sf))


@query("rolling_features", spec(ROLLING), over_facts(ROLLING), "facts")
def _(spark, sf):
    return series.rolling_features(src.daily_facts(spark, sf))


@query("trend_features", spec(TREND), over_facts(TREND), "facts")
def _(spark, sf):
    return series.trend_features(src.daily_facts(spark, sf))


@query("volatility_features", spec(VOLATILITY), over_facts(VOLATILITY), "facts")
def _(spark, sf):
    return series.volatility_features(src.daily_facts(spark, sf))


@query("order_velocity", spec(VELOCITY), over_facts(VELOCITY), "facts")
def _(spark, sf):
    return series.order_velocity(src.daily_facts(spark, sf))


MODEL = TIME_PARTS | LAGS | ROLLING | TREND | VOLATILITY | VELOCITY | SEASON


@query("model_features", spec(series.MODEL_FEATURES), over_facts(MODEL), "facts")
def _(spark, sf):
    return series.model_features(src.daily_facts(spark, sf))


def compact_sql(column: str) -> dict[str, str]:
    out = {f"lag_{k}": lag(column, k) for k in series.LAGS}
    out |= {f"rolling_mean_{n}": roll(column, n, "avg", 1) for n in series.WINDOWS}
    out |= {f"rolling_std_{n}": roll(column, n, "stddev_samp", 2) for n in (7, 28)}
    return out | {"day_of_week": "isodow(date) - 1", "month": "month(date)", "day_of_month": "day(date)",
                  "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)"}


@query("compact_features", spec(series.COMPACT_FEATURES), over_facts(compact_sql(Q)), "facts")
def _(spark, sf):
    return series.compact_features(src.daily_facts(spark, sf))


DYNAMIC_BASE = {f"advanced_demand_lag_{k}": lag(Q, k) for k in (1, 2, 7, 14, 28)}
DYNAMIC_BASE |= {f"advanced_mean_{n}": roll(Q, n, "avg", 1) for n in series.WINDOWS}
DYNAMIC_BASE |= {f"advanced_std_{n}": roll(Q, n, "stddev_samp", 2) for n in (7, 14, 28)}
cte("history", f"SELECT *, {lag(Q, 1)} AS h FROM facts", "facts")
cte("dynamic_base", f"""SELECT outlet_id, product_id, date, {columns(DYNAMIC_BASE)},
  {roll("h", 28, "count", 1, today=True)} AS seen,
  avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END) OVER ({SERIES} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS positive
FROM history""", "history")
DYNAMIC = {}
for _k, _o in ((1, 2), (7, 7), (14, 14), (28, 28)):
    DYNAMIC[f"advanced_demand_diff_{_k}"] = f"advanced_demand_lag_1 - advanced_demand_lag_{_o}"
for _a, _b in ((1, 7), (1, 14), (1, 28), (7, 14), (14, 28)):
    DYNAMIC[f"advanced_lag_ratio_{_a}_{_b}"] = f"advanced_demand_lag_{_a} / nullif(advanced_demand_lag_{_b}, 0)"
for _a, _b in ((3, 7), (7, 14), (14, 28)):
    DYNAMIC[f"advanced_momentum_{_a}_{_b}"] = f"advanced_mean_{_a} - advanced_mean_{_b}"
DYNAMIC["advanced_acceleration"] = "advanced_mean_3 - 2 * advanced_mean_7 + advanced_mean_14"
for _n in (7, 14):
    DYNAMIC[f"advanced_persistence_{_n}"] = f"advanced_demand_lag_1 / (abs(advanced_mean_{_n}) + 1e-6)"
    DYNAMIC[f"advanced_intensity_{_n}"] = f"advanced_mean_{_n} / (abs(advanced_mean_28) + 1e-6)"
DYNAMIC["advanced_persistence"] = "advanced_demand_lag_1 / (abs(advanced_mean_7) + 1e-6)"
DYNAMIC["advanced_nonzero_rate_28"] = "CASE WHEN seen >= 1 THEN positive END"
DYNAMIC["advanced_intermittency_28"] = "CASE WHEN seen >= 1 THEN 1.0 - positive END"
for _n in (7, 14, 28):
    DYNAMIC[f"advanced_cv_{_n}"] = f"advanced_std_{_n} / (abs(advanced_mean_{_n}) + 1e-6)"


@query("demand_dynamics", spec([*DYNAMIC_BASE, *DYNAMIC]),
       f"SELECT *, {columns(DYNAMIC)} FROM dynamic_base", "dynamic_base")
def _(spark, sf):
    return series.demand_dynamics(src.daily_facts(spark, sf))


cte("pair_history", f"""SELECT *, {expand(Q)} AS pm, {expand(Q, "stddev_samp", 2)} AS ps FROM history""", "history")
for _key, _name in (("outlet_id", "o"), ("product_id", "p")):
    _by = f"PARTITION BY {_key} ORDER BY date"
    cte(f"day_{_name}", f"""SELECT {_key}, date, t AS {_name}t,
  {expand("t", "avg", 1, True, _by)} AS {_name}m, {expand("t", "stddev_samp", 2, True, _by)} AS {_name}s
FROM (SELECT {_key}, date, coalesce(sum(h), 0) AS t FROM history GROUP BY 1, 2) d""", "history")
RELATION = {
    "advanced_pair_mean": "pm", "advanced_pair_std": "ps", "advanced_pair_cv": "ps / (abs(pm) + 1e-6)",
    "advanced_outlet_mean": "om", "advanced_outlet_mean_demand": "om", "advanced_outlet_std": "os",
    "advanced_product_mean": "prm", "advanced_product_mean_demand": "prm", "advanced_product_std": "prs",
    "advanced_outlet_relative_demand": "pm / (abs(om) + 1e-6)",
    "advanced_product_relative_demand": "pm / (abs(prm) + 1e-6)",
    "advanced_product_share_of_outlet": "h / (abs(ot) + 1e-6)",
    "advanced_outlet_share_of_product": "h / (abs(prt) + 1e-6)",
    "advanced_pair_vs_outlet": "pm - om", "advanced_pair_vs_product": "pm - prm",
    "advanced_pair_intensity": "pm / (abs(prm) + 1e-6)",
    "advanced_outlet_product_affinity": "pm / (abs(om * prm) + 1e-6)",
}


@query("outlet_product_features", spec(RELATION), f"""
SELECT h.outlet_id, h.product_id, h.date, {columns(RELATION)}
FROM pair_history h JOIN day_o USING (outlet_id, date)
JOIN (SELECT product_id, date, pt AS prt, pm AS prm, ps AS prs FROM day_p) p USING (product_id, date)
""", ("pair_history", "day_o", "day_p"))
def _(spark, sf):
    return series.outlet_product_features(src.daily_facts(spark, sf))


HISTORY = {f"history_lag_{k}": lag(Q, k) for k in series.HISTORY_LAGS}
for _n in series.WINDOWS:
    HISTORY[f"history_mean_{_n}"] = roll(Q, _n, "avg", 2)
    HISTORY[f"history_std_{_n}"] = roll(Q, _n, "stddev_samp", 2)
HISTORY |= {f"history_trend_{k}": f"{lag(Q, 1)} / ({lag(Q, k)} + 1e-6)" for k in (7, 28)}
HISTORY |= {f"history_volatility_{n}": f"({roll(Q, n, 'stddev_samp', 2)}) / (({roll(Q, n, 'avg', 2)}) + 1e-6)"
            for n in (7, 28)}
HISTORY |= {
    "calendar_dow": "isodow(date) - 1", "calendar_month": "month(date)", "calendar_day": "day(date)",
    "calendar_week": "weekofyear(date)", "calendar_quarter": "quarter(date)",
    "calendar_day_of_year": "dayofyear(date)", "calendar_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
    "calendar_dow_sin": TIME_PARTS["dow_sin"], "calendar_month_cos": TIME_PARTS["month_cos"],
}


@query("history_features", spec(HISTORY), over_facts(HISTORY), "facts")
def _(spark, sf):
    return series.temporal_features(src.daily_facts(spark, sf))


PAST = {f"lag_{k}": f"coalesce({lag(Q, k)}, 0)" for k in series.HISTORY_LAGS}
for _n in series.WINDOWS:
    for _name, _agg, _least in (("mean", "avg", 1), ("std", "stddev_samp", 2), ("max", "max", 1)):
        PAST[f"rolling_{_name}_{_n}"] = f"coalesce({roll(Q, _n, _agg, _least)}, 0)"
for _a, _b in ((7, 28), (3, 14)):
    PAST[f"trend_{_a}_{_b}"] = f"coalesce(({roll(Q, _a, 'avg', 1)}) / nullif({roll(Q, _b, 'avg', 1)}, 0), 0)"
for _n in (7, 28):
    PAST[f"volatility_{_n}"] = f"coalesce(({roll(Q, _n, 'stddev_samp', 2)}) / nullif({roll(Q, _n, 'avg', 1)}, 0), 0)"


@query("historical_max_features", spec(PAST), over_facts(PAST), "facts")
def _(spark, sf):
    return series.historical_features(src.daily_facts(spark, sf))


@query("history_prediction", f"{KEY} prediction:6",
       f"SELECT outlet_id, product_id, date, coalesce({lag(Q, 1)}, 0) AS prediction FROM facts", "facts")
def _(spark, sf):
    return series.history_prediction(series.historical_features(src.daily_facts(spark, sf)))


@query("state_sequences", f"{KEY} length:i first_value:6 last_value:6 total:6", f"""
SELECT outlet_id, product_id, date, 28 AS length, {lag(Q, 28)} AS first_value, {lag(Q, 1)} AS last_value,
  {roll(Q, 28, "sum")} AS total
FROM facts QUALIFY {lag(Q, 28)} IS NOT NULL""", "facts")
def _(spark, sf):
    from pyspark.sql import functions as F
    df = series.recent_state(src.daily_facts(spark, sf)).filter("sequence IS NOT NULL")
    return df.withColumns({
        "length": F.size("sequence"), "first_value": F.get("sequence", F.lit(0)),
        "last_value": F.get("sequence", F.lit(27)),
        "total": F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)})


# --- known context ---------------------------------------------------------------------------

cte("known", """
SELECT outlet_id, product_id, date, holiday_active AS known_holiday, promotion_active AS known_promotion,
  event_active AS known_event, 0.0 AS known_religious, temperature AS known_temperature,
  precipitation AS known_rainfall
FROM active_context
""", "active_context")


@query("known_context", f"{KEY} known_holiday:6 known_promotion:6 known_event:6 known_religious:6 "
       "known_temperature:6 known_rainfall:6", "SELECT * FROM known", "known")
def _(spark, sf):
    return cultural.known_context(with_context(spark, sf))


@query("context_interactions", f"{KEY} holiday_promotion:6 holiday_event:6 promotion_event:6 temperature_rain:6",
       """SELECT *, known_holiday * known_promotion AS holiday_promotion, known_holiday * known_event AS holiday_event,
  known_promotion * known_event AS promotion_event, known_temperature * known_rainfall AS temperature_rain
FROM known""", "known")
def _(spark, sf):
    return cultural.context_interactions(cultural.known_context(with_context(spark, sf)))


def _hash_sql(c: str) -> str:
    return (f"(('0x' || substr(sha256({c}), 1, 12))::BIGINT) / 281474976710656.0")


@query("entity_features", f"{KEY} entity_outlet_id:6 entity_product_id:6",
       over_facts({"entity_outlet_id": _hash_sql("outlet_id"), "entity_product_id": _hash_sql("product_id")}),
       "facts")
def _(spark, sf):
    return cultural.static_features(src.daily_facts(spark, sf))


@query("context_text", f"{KEY} context_text",
       """SELECT outlet_id, product_id, date,
  'outlet_id=' || trim(lower(outlet_id)) || ' product_id=' || trim(lower(product_id)) AS context_text
FROM facts""", "facts")
def _(spark, sf):
    return cultural.context_text(src.daily_facts(spark, sf), ["outlet_id", "product_id"])


@query("advanced_features", spec([
    "advanced_dow_sin_3", "advanced_month_end", "advanced_mean_7", "advanced_std_28",
    "advanced_persistence", "advanced_pair_mean", "advanced_outlet_mean", "advanced_context_intensity"]),
       f"""SELECT d.outlet_id, d.product_id, d.date, advanced_mean_7, advanced_std_28,
  {ADVANCED_TEMPORAL["advanced_dow_sin_3"].replace("date", "d.date")} AS advanced_dow_sin_3,
  CAST(day(d.date + 1) = 1 AS INTEGER) AS advanced_month_end,
  {DYNAMIC["advanced_persistence"]} AS advanced_persistence,
  pm AS advanced_pair_mean, om AS advanced_outlet_mean,
  holiday_active + promotion_active + event_active + is_rainy AS advanced_context_intensity
FROM dynamic_base d JOIN pair_history h USING (outlet_id, product_id, date)
JOIN day_o USING (outlet_id, date) JOIN active_context USING (outlet_id, product_id, date)""",
       ("dynamic_base", "pair_history", "day_o", "active_context"))
def _(spark, sf):
    from ..operators import leakage
    return leakage.advanced_features(with_context(spark, sf))

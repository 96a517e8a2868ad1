"""Calendar and context columns. Pure projections: no shuffle, fully inside codegen."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_col, column_or, require_columns

CONTEXT_FLAGS = ("holiday_active", "promotion_active", "event_active", "is_rainy")


def cycle(value, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    """(sin, cos) of a position inside a period."""
    angle = as_col(value) * F.lit(2 * pi * harmonic / period)
    return F.sin(angle), F.cos(angle)


def date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Year to ISO week, Monday = 0, weekend as boolean. A frame without the column passes."""
    if date not in df.columns:
        return df
    day = F.col(date).try_cast("date")
    return df.withColumns({
        date: day,
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "week_of_year": F.weekofyear(day),
        "is_weekend": F.weekday(day) >= 5,
    })


def time_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Date parts, 0/1 weekend, and the first weekday and month harmonics."""
    day = F.col(date)
    dow_sin, dow_cos = cycle(F.weekday(day), 7)
    month_sin, month_cos = cycle(F.month(day), 12)
    return date_parts(df, date).withColumns({
        "is_weekend": (F.weekday(day) >= 5).cast("int"),
        "day_of_year": F.dayofyear(day),
        "quarter": F.quarter(day),
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    })


def seasonality(df: DataFrame) -> DataFrame:
    """Second harmonics and the quarter cycle, on top of `time_features`."""
    require_columns(df, ["day_of_week", "month", "quarter", "is_weekend"], "seasonality")
    dow_sin, dow_cos = cycle("day_of_week", 7, 2)
    month_sin, month_cos = cycle(F.col("month") - 1, 12, 2)
    quarter_sin, quarter_cos = cycle(F.col("quarter") - 1, 4)
    return df.withColumns({
        "dow_sin_2": dow_sin,
        "dow_cos_2": dow_cos,
        "month_sin_2": month_sin,
        "month_cos_2": month_cos,
        "quarter_sin": quarter_sin,
        "quarter_cos": quarter_cos,
        "weekend_month_interaction": F.col("is_weekend") * F.col("month"),
    })


def advanced_temporal(df: DataFrame, date: str = "date") -> DataFrame:
    """Higher harmonics, weekend interactions, period edges and context interactions."""
    require_columns(df, [date], "advanced_temporal")
    day = F.col(date)
    month = F.month(day).cast("double")
    year_day = F.dayofyear(day).cast("double")
    weekend = (F.weekday(day) >= 5).cast("double")
    dow = cycle(F.weekday(day), 7, 3)
    half_year = cycle(month, 12, 2)
    week = cycle(F.weekofyear(day), 52)
    year = cycle(year_day, 365, 2)
    df = df.withColumns({name: column_or(df, name, 0.0) for name in CONTEXT_FLAGS})
    holiday, promotion, event = (F.col(c).cast("double") for c in CONTEXT_FLAGS[:3])
    last_of_month = F.last_day(day) == day
    return df.withColumns({
        "advanced_dow_sin_3": dow[0],
        "advanced_dow_cos_3": dow[1],
        "advanced_month_sin_2": half_year[0],
        "advanced_month_cos_2": half_year[1],
        "advanced_week_sin": week[0],
        "advanced_week_cos": week[1],
        "advanced_day_year_sin_2": year[0],
        "advanced_day_year_cos_2": year[1],
        "advanced_weekend_month": weekend * month,
        "advanced_weekend_quarter": weekend * F.quarter(day),
        "advanced_weekend_year_position": weekend * (year_day / 365.0),
        "advanced_month_start": (F.dayofmonth(day) == 1).cast("int"),
        "advanced_month_end": last_of_month.cast("int"),
        "advanced_quarter_start": (F.trunc(day, "quarter") == day).cast("int"),
        "advanced_quarter_end": (last_of_month & (F.month(day) % 3 == 0)).cast("int"),
        "advanced_holiday_weekend": holiday * weekend,
        "advanced_promotion_weekend": promotion * weekend,
        "advanced_event_weekend": event * weekend,
        "advanced_holiday_month": holiday * month,
        "advanced_promotion_month": promotion * month,
    })


def context_features(df: DataFrame) -> DataFrame:
    """Context columns, each only where its inputs are present."""
    have = set(df.columns)
    made: dict[str, Column] = {}
    if "temperature" in have:
        made["temperature_squared"] = F.col("temperature") * F.col("temperature")
    for source, target in (("precipitation", "is_rainy"), ("holiday_importance", "holiday_active"),
                           ("discount", "promotion_active")):
        if source in have:
            made[target] = F.when(F.col(source) > 0, 1).otherwise(0)
    if {"tourism_index", "student_index"} <= have:
        made["tourism_student_interaction"] = F.col("tourism_index") * F.col("student_index")
    if {"business_index", "population_density"} <= have:
        made["business_density_interaction"] = F.col("business_index") * F.col("population_density")
    return df.withColumns(made) if made else df


def advanced_context(df: DataFrame) -> DataFrame:
    """Products of context signals; inputs that are absent count as 0."""
    inputs = ("temperature", "temperature_squared", *CONTEXT_FLAGS,
              "tourism_student_interaction", "business_density_interaction")
    df = df.withColumns({name: column_or(df, name, 0.0) for name in inputs})
    (temperature, squared, holiday, promotion, event, rain, tourism, business) = (
        F.col(name).cast("double") for name in inputs)
    present = [F.coalesce(c, F.lit(0.0)) for c in (holiday, promotion, event, rain)]
    return df.withColumns({
        "advanced_temperature_rain": temperature * rain,
        "advanced_temperature_squared_rain": squared * rain,
        "advanced_holiday_rain": holiday * rain,
        "advanced_promotion_rain": promotion * rain,
        "advanced_event_rain": event * rain,
        "advanced_holiday_tourism": holiday * tourism,
        "advanced_event_tourism": event * tourism,
        "advanced_promotion_business": promotion * business,
        "advanced_event_business": event * business,
        "advanced_context_intensity": present[0] + present[1] + present[2] + present[3],
        "advanced_temperature_abs": F.abs(temperature),
        "advanced_temperature_rain_abs": F.abs(temperature) * rain,
    })

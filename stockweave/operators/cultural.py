"""Calendar and demographic context of demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, column_or, flag, gate, require_columns, to_number
from ..functions.windows import DAY_KEY, lagged, rolling
from .admission import calendar_input

IMPORTANCE = ("holiday", "religious", "event")
DEMOGRAPHIC_NUMBERS = ("population_density", "tourism_index", "student_index", "business_index",
                       "residential_index", "religious_population_share", "young_population_share",
                       "working_population_share")
DEMOGRAPHIC_LABELS = ("dominant_religious_context", "demographic_context", "city_class")


def prepare_calendar(df: DataFrame) -> DataFrame:
    """Canonical importance columns in [0, 1] and their active flags."""
    df = calendar_input(df)
    made: dict[str, Column] = {"date": F.col("date").cast("date")}
    for kind in IMPORTANCE:
        name = f"{kind}_importance"
        found = next((c for c in (name, f"{kind}_score", f"{kind}_strength") if c in df.columns), None)
        if found is None:
            made[name] = F.lit(0.0)
        else:
            made[name] = to_number(found)
            df = gate(df, ~flag(made[name].between(0.0, 1.0)), f"{name} must be a number within [0, 1]")
    df = df.withColumns(made)
    return df.withColumns({
        "holiday_active": (F.col("holiday_importance") > 0).cast("int"),
        "religious_period_active": (F.col("religious_importance") > 0).cast("int"),
        "event_active": (F.col("event_importance") > 0).cast("int"),
    })


def prepare_demographics(df: DataFrame) -> DataFrame:
    require_columns(df, ["outlet_id"], "demographics")
    made = {c: F.greatest(F.coalesce(to_number(column_or(df, c, 0.0)), F.lit(0.0)), F.lit(0.0))
            for c in DEMOGRAPHIC_NUMBERS}
    made |= {c: F.coalesce(column_or(df, c, None).cast("string"), F.lit("unknown"))
             for c in DEMOGRAPHIC_LABELS}
    return df.withColumns(made)


def cultural_effects(demand: DataFrame, calendar: DataFrame, demographics: DataFrame) -> DataFrame:
    """Exposure of each outlet to the calendar, and the demand pressure that follows.

    Calendar and demographics are joined without a hint: their size decides, through
    statistics and adaptive execution, whether they are broadcast.
    """
    require_columns(demand, [*DAY_KEY, "demand"], "demand")
    keys = [c for c in ("outlet_id", "date") if c in calendar.columns]
    people = [c for c in ("outlet_id", *DEMOGRAPHIC_NUMBERS, *DEMOGRAPHIC_LABELS) if c in demographics.columns]
    df = (demand.join(calendar, keys, "left")
                .join(demographics.select(*people).dropDuplicates(["outlet_id"]), "outlet_id", "left"))
    numbers = [*(f"{k}_importance" for k in IMPORTANCE), *DEMOGRAPHIC_NUMBERS]
    df = df.withColumns({c: F.coalesce(to_number(column_or(df, c, 0.0)), F.lit(0.0)) for c in numbers})
    holiday = F.col("holiday_importance")
    df = df.withColumns({
        "religious_context_exposure": F.col("religious_importance") * F.col("religious_population_share"),
        "tourism_context_exposure": F.col("tourism_index") * holiday,
        "student_context_exposure": F.col("student_index") * holiday,
        "business_context_exposure": F.col("business_index") * holiday,
        "working_population_exposure": F.col("working_population_share") * F.col("business_index"),
    })
    score = (0.40 * F.col("religious_context_exposure") + 0.25 * holiday
             + 0.20 * F.col("event_importance") + 0.15 * F.col("tourism_context_exposure"))
    reference = F.coalesce(rolling("demand", 28, F.avg, 7), lagged("demand"), F.col("demand"))
    df = df.withColumns({
        "cultural_context_score": clip(score, 0.0, 1.0),
        "historical_demand_reference": clip(reference, 0.0),
    })
    pressure = F.col("historical_demand_reference") * F.col("cultural_context_score")
    return df.withColumn("cultural_demand_pressure", F.greatest(F.coalesce(pressure, F.lit(0.0)), F.lit(0.0)))


# --- context of the feature ablation ------------------------------------------------------

# Accepted names of every known-context signal, in order of preference.
KNOWN_CONTEXT = {
    "known_holiday": ("holiday_active", "is_holiday", "holiday"),
    "known_promotion": ("promotion_active", "is_promotion", "promotion"),
    "known_event": ("event_active", "is_event", "event"),
    "known_religious": ("religious_holiday", "religious_active", "religious_event"),
    "known_cultural": ("cultural_context_score", "cultural_score"),
    "known_pressure": ("cultural_demand_pressure", "cultural_pressure"),
    "known_tourism": ("tourism_intensity", "tourism", "tourist_intensity"),
    "known_students": ("student_intensity", "students", "student_population"),
    "known_temperature": ("temperature", "temperature_c", "avg_temperature", "temp"),
    "known_rainfall": ("rainfall", "rainfall_mm", "rain", "precipitation"),
    "known_humidity": ("humidity", "humidity_pct"),
}

INTERACTIONS = {
    "holiday_promotion": ("holiday", "promotion"),
    "holiday_event": ("holiday", "event"),
    "promotion_event": ("promotion", "event"),
    "holiday_religious": ("holiday", "religious"),
    "cultural_holiday": ("cultural", "holiday"),
    "cultural_promotion": ("cultural", "promotion"),
    "tourism_students": ("tourism", "students"),
    "temperature_rain": ("temperature", "rainfall"),
}

ENTITY_COLUMNS = ("outlet_id", "product_id", "outlet_type", "location_type", "country", "region",
                  "product_category", "unit")


def known_context(df: DataFrame) -> DataFrame:
    made = {}
    for name, candidates in KNOWN_CONTEXT.items():
        found = next((c for c in candidates if c in df.columns), None)
        made[name] = F.coalesce(to_number(found), F.lit(0.0)) if found else F.lit(0.0)
    return df.withColumns(made)


def context_interactions(df: DataFrame) -> DataFrame:
    """Products of known-context pairs, on top of `known_context`."""
    return df.withColumns({name: F.col(f"known_{a}") * F.col(f"known_{b}")
                           for name, (a, b) in INTERACTIONS.items()})


def entity_hash(value: Column) -> Column:
    """Stable position of a label in [0, 1): the first 48 bits of its SHA-256."""
    digits = F.substring(F.sha2(value.cast("string"), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 12))


def static_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"entity_{c}": entity_hash(F.coalesce(F.col(c).cast("string"), F.lit("__missing__")))
        for c in ENTITY_COLUMNS if c in df.columns})


def context_text(df: DataFrame, text_columns: list[str], name: str = "context_text") -> DataFrame:
    """'column=value' words of the chosen columns, lower case, joined by a space."""
    columns = [c for c in text_columns if c in df.columns]
    parts = [F.concat(F.lit(f"{c}="), F.trim(F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))))
             for c in columns]
    return df.withColumn(name, F.concat_ws(" ", *parts) if parts else F.lit(""))


def visual_features(df: DataFrame, visual_columns: list[str]) -> DataFrame:
    """Image-derived number columns as they come; a column without any number is dropped."""
    columns = [c for c in visual_columns if c in df.columns]
    if not columns:
        return df.withColumns({"visual_available": F.lit(0.0), "visual_quality": F.lit(0.0)})
    filled = df.agg(*[F.count(to_number(c)).alias(c) for c in columns]).first()
    kept = [c for c in columns if filled[c]]
    df = df.drop(*set(columns) - set(kept))
    df = df.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in kept}) if kept else df
    if not kept:
        return df.withColumns({"visual_available": F.lit(0.0), "visual_quality": F.lit(0.0)})
    return df.withColumn("visual_quality", F.lit(1.0)) if len(kept) == 1 else df

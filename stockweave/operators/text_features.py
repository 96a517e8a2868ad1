"""Signals from free text, and their fusion with number and image-derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, column_or, to_number
from .leakage import is_forbidden

# The words of every signal. Terms with a space never match a single token.
SIGNALS = {
    "promotion": ("discount", "offer", "deal", "promo", "promotion", "coupon", "sale", "special", "combo"),
    "holiday": ("holiday", "festival", "festive", "celebration", "vacation", "public holiday"),
    "event": ("event", "concert", "match", "game", "conference", "wedding", "party", "festival"),
    "weather": ("rain", "rainy", "storm", "snow", "heat", "hot", "cold", "temperature", "weather"),
    "delivery": ("delivery", "deliver", "online", "app", "takeaway", "takeout"),
    "dine_in": ("restaurant", "dining", "dine", "dine-in", "table", "reservation"),
    "premium": ("premium", "luxury", "signature", "exclusive", "gourmet"),
    "vegetarian": ("vegetarian", "vegan", "plant-based", "veg"),
    "non_vegetarian": ("chicken", "beef", "lamb", "mutton", "fish", "seafood", "meat", "non-veg"),
    "beverage": ("coffee", "tea", "drink", "beverage", "juice", "bar", "cocktail", "mocktail"),
    "family": ("family", "kids", "children", "group"),
    "student": ("student", "university", "college", "campus"),
    "tourism": ("tourist", "tourism", "hotel", "visitor", "travel"),
    "urgency": ("limited", "today", "tonight", "last", "urgent", "ending"),
}
INTENSITY = ("very", "highly", "major", "huge", "massive", "exclusive", "limited", "special")


def tokenize(text: str | Column) -> Column:
    """Lower-case words of letters, digits and hyphens; an empty array for no words."""
    column = F.col(text) if isinstance(text, str) else text
    words = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^a-z0-9\s\-]", " ")
    return F.filter(F.split(words, r"\s+"), lambda w: w != "")


WATCHED = sorted({t for terms in (*SIGNALS.values(), INTENSITY) for t in terms})


def _count(tokens: Column, terms) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*terms)))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, scores and flags per signal, on the whole text of every row."""
    df = df.withColumn("_tokens", tokenize(text))
    # One hash lookup per word finds the few watched ones; the signals only look at those.
    df = df.withColumn("_hits", F.filter("_tokens", lambda t: t.isin(*WATCHED)))
    tokens, hits = F.col("_tokens"), F.col("_hits")
    df = df.withColumns({
        "text_token_count": F.size(tokens).cast("double"),
        "text_unique_token_count": F.size(F.array_distinct(tokens)).cast("double"),
        "text_length": F.length(F.coalesce(F.col(text), F.lit(""))).cast("double"),
        **{f"text_{name}_count": _count(hits, terms).cast("double") for name, terms in SIGNALS.items()},
        "_intense": _count(hits, INTENSITY).cast("double"),
    })
    size = F.greatest("text_token_count", F.lit(1.0))
    made: dict[str, Column] = {"text_vocabulary_density": F.col("text_unique_token_count") / size}
    for name in SIGNALS:
        count = F.col(f"text_{name}_count")
        made[f"text_{name}_score"] = F.least(count / size * 10.0, F.lit(1.0))
        made[f"text_has_{name}"] = (count > 0).cast("double")
    active = sum(((F.col(f"text_{name}_count") > 0).cast("double") for name in SIGNALS), F.lit(0.0))
    quality = 0.6 * F.least(F.col("text_token_count") / 20.0, F.lit(1.0)) + 0.4 * F.col("text_unique_token_count") / size
    made |= {
        "text_intensity": F.least(F.col("_intense") / size * 10.0, F.lit(1.0)),
        "text_context_count": active,
        "text_context_density": active / float(len(SIGNALS)),
        "text_quality": F.when(F.col("text_token_count") > 0, F.least(quality, F.lit(1.0))).otherwise(0.0),
        "text_available": F.lit(1.0),
    }
    return df.withColumns(made).drop("_tokens", "_hits", "_intense")


# Share of each modality in the fusion score.
WEIGHTS = {"numeric": 0.5, "text": 0.25, "visual": 0.25}


def fuse(df: DataFrame, numeric=(), text=(), visual=(), text_available: Column | bool = True,
         visual_available: Column | bool = False, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Prefix the features of each modality, add six interactions and two quality scores.

    A modality may be absent for a row: its features then count as 0 and its weight is not
    part of the score.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("modality weights must not be negative and not all 0")
    total = sum(weights.values())
    w = {k: v / total for k, v in weights.items()}
    has = {"text": F.lit(text_available) if isinstance(text_available, bool) else text_available,
           "visual": F.lit(visual_available) if isinstance(visual_available, bool) else visual_available}

    def value(name: str) -> Column:
        return F.coalesce(to_number(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    def given(kind: str, name: str) -> Column:
        return F.when(has[kind], value(name)).otherwise(0.0)

    safe = [c for c in numeric if not is_forbidden(c)]
    made: dict[str, Column] = {f"mm_numeric_{c}": value(c) for c in safe}
    made |= {f"mm_text_{c}": given("text", c) for c in text}
    made |= {f"mm_visual_{c}": given("visual", c) for c in visual}
    quality = {k: clip(F.coalesce(column_or(df, f"{k}_quality", 0.0), F.lit(0.0)), 0.0, 1.0) for k in ("text", "visual")}
    quality = {k: F.when(has[k], q).otherwise(0.0) for k, q in quality.items()}
    demand = value("demand") if "demand" in df.columns else value("forecast_demand")
    context, promotion = given("text", "text_context_density"), given("text", "text_promotion_score")
    present = w["numeric"] + sum((F.when(has[k], w[k]).otherwise(0.0) for k in has), F.lit(0.0))
    score = (w["numeric"] + w["text"] * quality["text"] + w["visual"] * quality["visual"]) / F.greatest(present, F.lit(1e-12))
    made |= {
        "mm_has_numeric": F.lit(1.0),
        "mm_has_text": has["text"].cast("double"),
        "mm_has_visual": has["visual"].cast("double"),
        "mm_modality_count": 1.0 + has["text"].cast("double") + has["visual"].cast("double"),
        "mm_text_quality": quality["text"],
        "mm_visual_quality": quality["visual"],
        "mm_text_numeric_interaction": context * demand,
        "mm_promotion_numeric_interaction": promotion * demand,
        "mm_event_numeric_interaction": given("text", "text_event_score") * demand,
        "mm_weather_numeric_interaction": given("text", "text_weather_score") * demand,
        "mm_text_visual_interaction": context * given("visual", "visual_mean_brightness"),
        "mm_promotion_visual_interaction": promotion * given("visual", "visual_mean_saturation"),
        "mm_fusion_score": clip(present * score, 0.0, 1.0),
        "mm_quality_score": clip(score, 0.0, 1.0),
    }
    return df.withColumns(made)

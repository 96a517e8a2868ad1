"""Prediction intervals from calibration residuals.

Fitting returns a handful of numbers (exact order statistics of the residuals); applying them
is a projection.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_col, clip, first_rule
from ..plans.quantiles import as_long, exact_quantiles, interpolate, order_statistics, quantile_ranks, select_ranks

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
DISTRIBUTION = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def label(q: float) -> str:
    return f"p{round(q * 100):02d}"


def _residual(actual, predicted) -> Column:
    return as_col(actual) - as_col(predicted)


def _bounded(value: Column, non_negative: bool) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))) if non_negative else value


def conformal_rank(coverage: float):
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie in (0, 1)")
    # The product is rounded first, so that (n + 1) * 0.9 = 90.00000000000001 stays 90.
    return lambda n: [max(1, min(ceil(round((n + 1) * coverage, 9)), n)) - 1]


def conformal_radius(calibration: DataFrame, actual="actual", predicted="predicted", coverage: float = 0.9) -> float:
    """The ceil((n+1) coverage)-th smallest absolute residual: an order statistic, no interpolation."""
    rank = conformal_rank(coverage)
    n, found = order_statistics(calibration, F.abs(_residual(actual, predicted)), rank)
    if not n:
        raise ValueError("no calibration row has both values")
    return found[rank(n)[0]]


def conformal_interval(df: DataFrame, radius: float, point="predicted", non_negative: bool = True) -> DataFrame:
    p = as_col(point)
    return df.withColumns({"lower": _bounded(p - radius, non_negative), "upper": _bounded(p + radius, non_negative)})


def residual_quantiles(calibration: DataFrame, probabilities, actual="actual", predicted="predicted") -> list[float]:
    found = exact_quantiles(calibration, _residual(actual, predicted), list(probabilities))
    if found and found[0] is None:
        raise ValueError("no calibration row has both values")
    return found


def asymmetric_interval(df: DataFrame, low: float, high: float, point="predicted", non_negative: bool = True) -> DataFrame:
    p = as_col(point)
    return df.withColumns({"asymmetric_lower": _bounded(p + low, non_negative),
                           "asymmetric_upper": _bounded(p + high, non_negative)})


def quantile_forecast(df: DataFrame, shifts: dict[float, float], point="predicted", non_negative: bool = True) -> DataFrame:
    """p10 .. p90 around the point; the median is the point itself."""
    p = as_col(point)
    return df.withColumns({label(q): _bounded(p if q == 0.5 else p + shift, non_negative) for q, shift in shifts.items()})


def residual_profile(calibration: DataFrame, actual="actual", predicted="predicted") -> dict[str, float]:
    r = _residual(actual, predicted)
    return calibration.agg(
        F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std"),
        F.avg((r > 0).cast("double")).alias("positive"), F.avg((r < 0).cast("double")).alias("negative")).first().asDict()


def predictive_distribution(df: DataFrame, calibration: DataFrame, actual="actual", predicted="predicted",
                            point="predicted", non_negative: bool = True) -> DataFrame:
    """Seven quantiles, mean, deviation, 80 and 90 % bounds and residual sign shares."""
    shifts = dict(zip(DISTRIBUTION, residual_quantiles(calibration, DISTRIBUTION, actual, predicted)))
    profile = residual_profile(calibration, actual, predicted)
    p = as_col(point)
    df = df.withColumns({label(q): _bounded(p + s, non_negative) for q, s in shifts.items()})
    made: dict[str, Column] = {"predictive_mean": p + profile["mean"], "predictive_std": F.lit(profile["std"])}
    for level, low, high in ((90, "p05", "p95"), (80, "p10", "p90")):
        made |= {f"predictive_lower_{level}": F.col(low), f"predictive_upper_{level}": F.col(high),
                 f"predictive_width_{level}": F.col(high) - F.col(low)}
    made |= {"residual_positive_probability": F.lit(profile["positive"]),
             "residual_negative_probability": F.lit(profile["negative"])}
    return df.withColumns(made)


def probabilistic_forecast(df: DataFrame, calibration: DataFrame, actual="actual", predicted="predicted",
                           coverage: float = 0.9) -> DataFrame:
    """Quantiles, conformal and asymmetric interval for every row."""
    residual, radius_rank = _residual(actual, predicted), conformal_rank(coverage)
    found = select_ranks(as_long(calibration, {"signed": residual, "absolute": F.abs(residual)}),
                         {"signed": quantile_ranks(QUANTILES), "absolute": radius_rank})
    if not found:
        raise ValueError("no calibration row has both values")
    (n, signed), (_, absolute) = found["signed"], found["absolute"]
    shifts = {q: interpolate(signed, n, q) for q in QUANTILES}
    radius = absolute[radius_rank(n)[0]]
    return (df.transform(quantile_forecast, shifts, predicted)
              .transform(conformal_interval, radius, predicted)
              .transform(asymmetric_interval, shifts[0.10], shifts[0.90], predicted))


def pinball(actual, forecast, q: float) -> Column:
    e = as_col(actual) - as_col(forecast)
    return F.avg(F.greatest(q * e, (q - 1.0) * e))


def coverage_rate(actual, lower, upper) -> Column:
    a, lo, hi = as_col(actual), as_col(lower), as_col(upper)
    return F.avg(((a >= lo) & (a <= hi)).cast("double"))


def calibration_report(df: DataFrame, actual="actual") -> DataFrame:
    """(name, quantile, pinball_loss, below_rate, coverage, mean_width) of a probabilistic forecast."""
    a = as_col(actual)
    measures = [F.count(F.lit(1)).alias("n")]
    for q in QUANTILES:
        name = label(q)
        measures += [pinball(a, name, q).alias(f"{name}_loss"), F.avg((a < F.col(name)).cast("double")).alias(f"{name}_below")]
    pairs = {"conformal_90": ("lower", "upper"), "asymmetric_80": ("asymmetric_lower", "asymmetric_upper")}
    for name, (lo, hi) in pairs.items():
        measures += [coverage_rate(a, lo, hi).alias(f"{name}_coverage"), F.avg(F.col(hi) - F.col(lo)).alias(f"{name}_width")]
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(label(q)).alias("name"), F.lit(q).alias("quantile"), F.col(f"{label(q)}_loss").alias("pinball_loss"),
                     F.col(f"{label(q)}_below").alias("below_rate"), none.alias("coverage"), none.alias("mean_width"))
            for q in QUANTILES]
    rows += [F.struct(F.lit(n).alias("name"), none.alias("quantile"), none.alias("pinball_loss"), none.alias("below_rate"),
                      F.col(f"{n}_coverage").alias("coverage"), F.col(f"{n}_width").alias("mean_width")) for n in pairs]
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def error_profile(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Count, mean, deviation, MAE and exact percentiles of the absolute error in one row."""
    r = _residual(actual, predicted)
    known = df.filter(r.isNotNull())
    marks = (0.50, 0.75, 0.90, 0.95, 0.99)
    found = exact_quantiles(known, F.abs(r), list(marks))
    one = known.agg(F.count(F.lit(1)).alias("count"), F.avg(r).alias("mean_error"),
                    F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_error"), F.avg(F.abs(r)).alias("mae"))
    return one.withColumns({f"{label(q)}_absolute_error": F.lit(v) for q, v in zip(marks, found)})


def empirical_interval(df: DataFrame, low: float, high: float, point="predicted") -> DataFrame:
    p = as_col(point)
    return df.withColumns({"lower_bound": _bounded(p + low, True), "upper_bound": _bounded(p + high, True)})


def confidence(df: DataFrame, point="predicted", lower="lower_bound", upper="upper_bound") -> DataFrame:
    """1 for a point, falling with the interval width relative to the prediction."""
    width = as_col(upper) - as_col(lower)
    value = clip(1.0 / (1.0 + width / F.greatest(F.abs(as_col(point)), F.lit(1.0))), 0.0, 1.0)
    df = df.withColumn("confidence", value)
    return df.withColumn("confidence_label", first_rule(
        [(F.col("confidence") >= 0.8, "high"), (F.col("confidence") >= 0.6, "medium")], "low"))


def uncertainty(df: DataFrame, low: float, high: float, point="predicted") -> DataFrame:
    return confidence(empirical_interval(df, low, high, point), point)


def reliability(df: DataFrame, actual="actual", lower="lower_bound", upper="upper_bound") -> DataFrame:
    width = as_col(upper) - as_col(lower)
    (middle,) = exact_quantiles(df, width, [0.5])
    one = df.agg(coverage_rate(actual, lower, upper).alias("coverage"), F.avg(width).alias("mean_interval_width"))
    return one.withColumn("median_interval_width", F.lit(middle))


def forecast_violations(df: DataFrame) -> DataFrame:
    """Crossing quantiles, inverted bounds and missing values of a probabilistic forecast."""
    names = [label(q) for q in QUANTILES]
    bad = {f"{a}_above_{b}": F.col(a) > F.col(b) + 1e-9 for a, b in zip(names, names[1:])}
    bad["lower_above_upper"] = F.col("lower") > F.col("upper") + 1e-9
    bad |= {f"{n}_missing": F.col(n).isNull() for n in names}
    return df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in bad.items()])

"""Forecast accuracy. Plain metrics are one aggregation; thresholds that are quantiles of a
whole column come from `plans.quantiles`, those of one series from a window on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_col, clip, count_where
from ..functions.windows import DAY_KEY, SERIES
from ..plans.lineage import cut
from ..plans.quantiles import column_quantiles, exact_quantiles


def smape_term(actual, predicted, variant: str = "skip") -> Column:
    """One row's share of sMAPE. Variants treat a zero denominator differently: "skip" leaves
    the row out, "zero" counts it as 0, "threshold" does so below 1e-12, "epsilon" adds 1e-6."""
    a, p = as_col(actual), as_col(predicted)
    gap, size = 2.0 * F.abs(a - p), F.abs(a) + F.abs(p)
    if variant == "epsilon":
        return gap / (size + 1e-6)
    floor = 1e-12 if variant == "threshold" else 0.0
    term = F.when(size > floor, gap / F.nullif(size, F.lit(0.0)))
    if variant == "skip":
        return term
    return F.when(size.isNotNull(), F.coalesce(term, F.lit(0.0)))


def basic_metrics(actual="actual", predicted="predicted", variant: str = "skip") -> list[Column]:
    a, p = as_col(actual), as_col(predicted)
    return [
        F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        (F.coalesce(F.avg(smape_term(a, p, variant)), F.lit(0.0)) * 100.0).alias("smape"),
        F.avg(p - a).alias("bias"),
    ]


def evaluate(df: DataFrame, actual="actual", predicted="predicted", by=(), variant: str = "skip") -> DataFrame:
    """MAE, RMSE, sMAPE and bias, per group or over all rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *basic_metrics(actual, predicted, variant))


def paired(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Rows on which both sides are known."""
    return df.filter(as_col(actual).isNotNull() & as_col(predicted).isNotNull())


def candidate_metrics(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    return paired(df, actual, predicted).agg(F.count(F.lit(1)).alias("count"), *basic_metrics(actual, predicted)).drop("smape")


def row_errors(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    error = as_col(predicted) - as_col(actual)
    return df.withColumns({"error": error, "absolute_error": F.abs(error), "squared_error": error * error})


def bias_analysis(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    error = as_col(predicted) - as_col(actual)
    return df.agg(
        F.avg(error).alias("mean_bias"),
        F.avg((error > 0).cast("double")).alias("overforecast_rate"),
        F.avg((error < 0).cast("double")).alias("underforecast_rate"),
        F.max(error).alias("max_overforecast"), F.min(error).alias("max_underforecast"))


def high_demand(df: DataFrame, actual="actual", predicted="predicted", quantile: float = 0.9) -> DataFrame:
    """The metrics on rows at or above a quantile of the actual values."""
    (threshold,) = exact_quantiles(df, actual, [quantile])
    found = evaluate(df.filter(as_col(actual) >= F.lit(threshold)), actual, predicted)
    return found.withColumn("threshold", F.lit(threshold))


def spike_recall(df: DataFrame, actual="actual", predicted="predicted", quantile: float = 0.9) -> DataFrame:
    """Share of the highest actual rows whose prediction is among the highest predictions."""
    (a,), (p,) = column_quantiles(df, {"actual": actual, "predicted": predicted}, [quantile]).values()
    spikes = df.filter(as_col(actual) >= F.lit(a))
    return spikes.agg(F.coalesce(F.avg((as_col(predicted) >= F.lit(p)).cast("double")), F.lit(0.0)).alias("spike_recall"))


def diagnostic_report(df: DataFrame, actual="actual", predicted="predicted", groups=("outlet_id", "product_id"), quantile: float = 0.9) -> DataFrame:
    """One report as (section, item, metric, value): overall metrics, bias, high demand, spike recall, and every group's metrics.

    The thresholds come from one selection, everything else from one aggregate over all rows and one per kind of group.
    """
    df = cut(df.select(as_col(actual).alias("a"), as_col(predicted).alias("p"), *groups))
    (high,), (spike,) = column_quantiles(df, {"a": "a", "p": "p"}, [quantile]).values()
    a, p = F.col("a"), F.col("p")

    def named(section: str, item, measures: dict[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(section).alias("section"), item.alias("item"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
                         for m, c in measures.items()])

    plain = {"count": F.count(F.lit(1)), **dict(zip(("mae", "rmse", "smape", "bias"), basic_metrics(a, p)))}
    tops = F.when(a >= F.lit(high), F.lit(True))
    made = {f"overall.{m}": c for m, c in plain.items()}
    made |= {"bias.mean_bias": F.avg(p - a), "bias.overforecast_rate": F.avg((p > a).cast("double")), "bias.underforecast_rate": F.avg((p < a).cast("double")),
             "bias.max_overforecast": F.max(p - a), "bias.max_underforecast": F.min(p - a)}
    made |= {"high_demand.threshold": F.lit(high).cast("double"), "high_demand.count": F.count(tops), "high_demand.mae": F.avg(F.when(tops, F.abs(p - a))),
             "high_demand.rmse": F.sqrt(F.avg(F.when(tops, (p - a) * (p - a)))), "high_demand.bias": F.avg(F.when(tops, p - a)),
             "spikes.recall": F.coalesce(F.avg(F.when(tops, (p >= F.lit(spike)).cast("double"))), F.lit(0.0))}
    one = df.agg(*[c.alias(name.replace(".", "__")) for name, c in made.items()])
    rows = one.select(F.inline(F.array(*[F.struct(
        F.lit(name.split(".")[0]).alias("section"), F.lit("").alias("item"), F.lit(name.split(".")[1]).alias("metric"),
        F.col(name.replace(".", "__")).cast("double").alias("value")) for name in made])))
    for group in groups:
        each = df.groupBy(group).agg(*[c.alias(m) for m, c in plain.items()])
        rows = rows.unionByName(each.select(F.inline(named(group, F.col(group).cast("string"), {m: m for m in plain}))))
    return rows


def group_diagnostics(df: DataFrame, by: str, actual="actual", predicted="predicted") -> DataFrame:
    return evaluate(df, actual, predicted, [by]).orderBy(F.desc("mae"), by)


def horizon_evaluation(actuals: DataFrame, predictions: DataFrame, target: str = "quantity_sold") -> DataFrame:
    """Join forecasts to what happened and measure each horizon."""
    joined = predictions.join(actuals.select(*DAY_KEY, target), list(DAY_KEY))
    return evaluate(joined, target, "prediction", ["horizon"])


def ablation_metrics(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Metrics of one ablation mode: high demand from q75, recall at the actual q90."""
    q75, q90 = exact_quantiles(df, actual, [0.75, 0.90])
    a, p = as_col(actual), as_col(predicted)
    return df.agg(
        *basic_metrics(a, p, "threshold"),
        F.coalesce(F.avg(F.when(a >= F.lit(q75), F.abs(p - a))), F.lit(0.0)).alias("high_demand_mae"),
        F.coalesce(F.avg(F.when(a >= F.lit(q90), (p >= F.lit(q90)).cast("double"))), F.lit(0.0)).alias("spike_recall"))


def model_scores(df: DataFrame, keys=SERIES, order: str = "horizon") -> DataFrame:
    """Full comparison metrics per series and model: accuracy, high demand, recall, stability.

    `df` is long: keys, model_name, order, actual, predicted. Quantiles are those of one
    series' test window.
    """
    by = [*keys, "model_name"]
    group = Window.partitionBy(*by)
    q = F.lit(0.9)
    marked = df.withColumns({
        "_a90": F.percentile("actual", q).over(group),
        "_p90": F.percentile("predicted", q).over(group),
        "_step": F.col("predicted") - F.lag("predicted").over(group.orderBy(order)),
    })
    high = F.col("actual") >= F.col("_a90")
    error = F.col("predicted") - F.col("actual")
    scores = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("test_rows"), *basic_metrics(variant="zero"),
        F.avg(F.when(high, F.abs(error))).alias("high_demand_mae"),
        F.avg(F.when(high, error)).alias("high_demand_bias"),
        F.avg(F.when(high, (F.col("predicted") >= F.col("_p90")).cast("double"))).alias("spike_recall"),
        F.stddev_pop("_step").alias("_volatility"), F.avg(F.abs("predicted")).alias("_scale"))
    steady = (F.col("test_rows") < 2) | (F.col("_scale") <= 1e-12)
    return scores.withColumns({
        "stability": F.when(steady, 1.0).otherwise(1.0 / (1.0 + F.col("_volatility") / F.nullif(F.col("_scale"), F.lit(0.0)))),
        "prediction_cost": F.lit(0.0),
    }).drop("_volatility", "_scale")


def train_threshold_scores(df: DataFrame, train: DataFrame, target: str, keys=SERIES) -> DataFrame:
    """Per series and model, with high-demand and spike cuts from the training history."""
    cuts = train.groupBy(*keys).agg(F.percentile(target, F.array(F.lit(0.90), F.lit(0.95))).alias("_cuts"))
    joined = df.join(cuts, list(keys))
    high, spike = F.col("actual") >= F.get("_cuts", F.lit(0)), F.col("actual") >= F.get("_cuts", F.lit(1))
    error = F.col("predicted") - F.col("actual")
    zero = F.lit(0.0)
    return joined.groupBy(*keys, "model_name").agg(
        F.count(F.lit(1)).alias("n_test"), *basic_metrics(variant="epsilon"),
        F.coalesce(F.avg(F.when(high, F.abs(error))), zero).alias("high_demand_mae"),
        F.coalesce(F.avg(F.when(high, error)), zero).alias("high_demand_bias"),
        F.coalesce(F.avg(F.when(spike, (F.col("predicted") >= F.get("_cuts", F.lit(1))).cast("double"))), zero)
         .alias("spike_recall"))


WEIGHTED = ("mae", "rmse", "smape", "bias", "high_demand_mae", "high_demand_bias", "spike_recall")


def weighted_by_model(scores: DataFrame) -> DataFrame:
    """Per model the test-size weighted mean of the per-series metrics, ranked by MAE."""
    n = F.col("n_test")
    out = scores.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("series_count"), F.sum(n).alias("test_observations"),
        *[(F.sum(F.col(c) * n) / F.sum(n)).alias(c) for c in WEIGHTED])
    # One row per model from here on.
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mae", "rmse", "model_name"))
    return out.withColumn("rank", place).withColumn("winner", F.col("rank") == 1)


def best_models(scores: DataFrame, keys=SERIES) -> DataFrame:
    """Per series the MAE of every model side by side, the lowest and whose it is."""
    return scores.groupBy(*keys).agg(
        F.min("mae").alias("best_mae"),
        F.min_by("model_name", F.struct("mae", "model_name")).alias("best_model"))


def pivot_models(scores: DataFrame, models, keys=SERIES) -> DataFrame:
    wide = scores.groupBy(*keys).pivot("model_name", list(models)).agg(F.first("mae"))
    lowest = F.least(*[F.col(m) for m in models])
    chain = None
    for m in models:
        chain = F.when(F.col(m) == lowest, m) if chain is None else chain.when(F.col(m) == lowest, m)
    return wide.withColumns({"best_mae": lowest, "best_model": chain})


def switch_decision(scores: DataFrame, champion: str, challenger: str, gain: float = 0.02,
                    win_rate: float = 0.50, keys=SERIES) -> DataFrame:
    """Switch only for a meaningful weighted gain that also wins enough series."""
    n = F.col("n_test")
    wide = scores.groupBy(*keys).agg(
        F.max(F.when(F.col("model_name") == champion, F.col("mae"))).alias("old"),
        F.max(F.when(F.col("model_name") == challenger, F.col("mae"))).alias("new"),
        F.max(n).alias("n"))
    one = wide.agg(
        (F.sum(F.col("old") * F.col("n")) / F.sum("n")).alias("champion_mae"),
        (F.sum(F.col("new") * F.col("n")) / F.sum("n")).alias("challenger_mae"),
        F.avg((F.col("new") < F.col("old")).cast("double")).alias("series_win_rate"))
    one = one.withColumn("improvement", (F.col("champion_mae") - F.col("challenger_mae"))
                         / F.greatest("champion_mae", F.lit(1e-9)))
    better = (F.col("improvement") >= gain) & (F.col("series_win_rate") >= win_rate)
    return one.withColumn("recommendation", F.when(better, "SWITCH").otherwise("KEEP"))


# --- demand estimate against the truth ------------------------------------------------------------

def recovery(actual, predicted) -> Column:
    a, p = as_col(actual), as_col(predicted)
    size = F.sum(F.abs(a))
    return F.when(size > 1e-12, 1.0 - F.sum(F.abs(a - p)) / F.nullif(size, F.lit(0.0))).otherwise(1.0)


def estimate_validation(intelligence: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how close the reconstructed demand is to the truth, on all and on stockout rows."""
    joined = intelligence.join(truth.select(*DAY_KEY, "true_demand", "lost_demand"), list(DAY_KEY))
    zero = F.lit(0.0)
    d, t, e, l, sold, filled = (F.coalesce(F.col(c).cast("double"), zero) for c in (
        "deconstrained_demand", "true_demand", "estimated_lost_demand", "lost_demand", "quantity_sold",
        "estimated_fulfillment_rate"))
    out = F.coalesce(F.col("stockout"), F.lit(False))

    def only(c: Column) -> Column:
        return F.when(out, c)

    true_rate = clip(sold / F.greatest(t, F.lit(1e-9)), 0.0, 1.0)
    flagged = F.coalesce(F.col("demand_constrained_estimated"), F.lit(False)) == (l > 1e-9)
    return joined.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.avg(F.abs(d - t)).alias("demand_mae"), F.sqrt(F.avg((d - t) * (d - t))).alias("demand_rmse"),
        F.avg(d - t).alias("demand_bias"), recovery(t, d).alias("demand_recovery"),
        F.avg(F.abs(e - l)).alias("lost_demand_mae"), F.sqrt(F.avg((e - l) * (e - l))).alias("lost_demand_rmse"),
        F.avg(e - l).alias("lost_demand_bias"), recovery(l, e).alias("lost_demand_recovery"),
        F.coalesce(F.avg(flagged.cast("double")), F.lit(1.0)).alias("constraint_accuracy"),
        F.avg(F.abs(true_rate - filled)).alias("fulfillment_mae"),
        count_where(out).alias("stockout_rows"),
        F.coalesce(F.avg(only(F.abs(d - t))), zero).alias("stockout_demand_mae"),
        F.coalesce(F.sqrt(F.avg(only((d - t) * (d - t)))), zero).alias("stockout_demand_rmse"),
        F.coalesce(F.avg(only(d - t)), zero).alias("stockout_demand_bias"),
        F.coalesce(F.avg(only(F.abs(e - l))), zero).alias("stockout_lost_demand_mae"),
        recovery(only(l), only(e)).alias("stockout_lost_demand_recovery"))


def truth_relations(truth: DataFrame) -> DataFrame:
    """One row: does the truth add up?"""
    t, s, l = (F.col(c).cast("double") for c in ("true_demand", "observed_sales", "lost_demand"))
    return truth.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bool_and(t >= s - 1e-9), F.lit(True)).alias("true_demand_ge_observed"),
        F.coalesce(F.bool_and(l >= -1e-9), F.lit(True)).alias("lost_demand_nonnegative"),
        F.coalesce(F.bool_and(~F.coalesce(F.col("stockout"), F.lit(False)) | (l > -1e-9)), F.lit(True))
         .alias("stockout_has_lost_demand"),
        F.max(F.abs(t - s - l)).alias("max_accounting_error"))


def output_integrity(result: DataFrame) -> DataFrame:
    d, s, l, c = (F.col(x) for x in ("deconstrained_demand", "quantity_sold", "estimated_lost_demand", "censoring_strength"))
    return result.agg(
        F.count(F.lit(1)).alias("rows"), count_where(d.isNull()).alias("null_demand"),
        count_where(l.isNull()).alias("null_lost_demand"),
        count_where(d < s - 1e-9).alias("demand_below_observed"),
        count_where(l < -1e-9).alias("negative_lost_demand"),
        count_where((c < -1e-9) | (c > 1 + 1e-9)).alias("invalid_censoring_strength"),
        count_where(F.coalesce(F.col("stockout"), F.lit(False))).alias("stockout_records"),
        count_where(F.coalesce(F.col("censored_demand_flag"), F.lit(False))).alias("censored_records"))


def acceptance(truth: DataFrame, output: DataFrame, overall: DataFrame) -> DataFrame:
    """Ten gates over the three one-row reports."""
    one = (truth.drop("rows").join(F.broadcast(output.drop("rows")), F.lit(True))
                .join(F.broadcast(overall), F.lit(True)))
    gates = {
        "truth_demand_relationship": F.col("true_demand_ge_observed"),
        "truth_lost_demand_relationship": F.col("lost_demand_nonnegative"),
        "truth_accounting": F.col("max_accounting_error") <= 0.001,
        "output_no_missing_demand": F.col("null_demand") == 0,
        "output_no_missing_lost_demand": F.col("null_lost_demand") == 0,
        "output_demand_not_below_sales": F.col("demand_below_observed") == 0,
        "output_lost_demand_nonnegative": F.col("negative_lost_demand") == 0,
        "censoring_strength_valid": F.col("invalid_censoring_strength") == 0,
        "demand_recovery_positive": F.col("demand_recovery") > 0,
        "lost_demand_recovery_positive": F.col("lost_demand_recovery") > 0,
    }
    one = one.select(*[c.alias(name) for name, c in gates.items()])
    passed = F.lit(True)
    for name in gates:
        passed = passed & F.col(name)
    return one.withColumn("passed", passed)

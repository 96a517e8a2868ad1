"""Boosted-tree forecasting with Spark ML: training, prediction, recursive D+1..D+7.

Training is distributed; rows with a missing feature are left out. Values depend on Spark's tree
learner, so results are checked by invariants, not by SQL.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, require_columns
from ..functions.windows import SERIES
from ..plans.lineage import cut
from . import admission, calendar, drift, leakage, metrics, series, splits

HORIZONS = (1, 3, 7)
STATE = 28


def train(features: DataFrame, columns, target: str = "quantity_sold", min_rows: int = 100, loss: str = "squared",
          max_iter: int = 60, max_depth: int = 5, step: float = 0.1, subsample: float = 0.85, seed: int = 42) -> PipelineModel:
    """Fit boosted trees on the rows that have every feature and the target."""
    require_columns(features, [*columns, target], "training features")
    bad = leakage.forbidden_features([c for c in columns if c != target], leakage.CONTRACT_FORBIDDEN)
    if bad:
        raise ValueError(f"forbidden model inputs {bad}")
    rows = features.select(*[F.col(c).cast("double").alias(c) for c in columns],
                           F.col(target).cast("double").alias("label")).dropna()
    rows = cut(rows)
    found = rows.count()
    if found < min_rows:
        raise ValueError(f"{found} complete training rows, {min_rows} are needed")
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", lossType=loss, maxIter=max_iter,
                         maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(rows)


def inputs(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(model: PipelineModel, features: DataFrame, name: str = "prediction") -> DataFrame:
    """Add the prediction, never negative; NULL where a feature is missing."""
    columns = inputs(model)
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    # Rows with gaps are scored on zeros and blanked, so no row is dropped and no join is needed.
    filled = features.withColumns({f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    assembler = VectorAssembler(inputCols=[f"_in_{c}" for c in columns], outputCol="_features")
    trees = model.stages[1].copy().setFeaturesCol("_features").setPredictionCol("_score")
    scored = trees.transform(assembler.transform(filled))
    value = F.when(known, F.greatest("_score", F.lit(0.0)))
    return scored.withColumn(name, value).drop("_features", "_score", *[f"_in_{c}" for c in columns])


def feature_importance(model: PipelineModel) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(inputs(model), values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# --- recursive forecast ----------------------------------------------------------------------------

def series_state(history: DataFrame, target: str = "quantity_sold", length: int = STATE, keys=SERIES) -> DataFrame:
    """The last values of every series as an array, oldest first."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    kept = F.when(F.col("_back") <= length, F.struct((-F.col("_back")).alias("o"), F.col(target).cast("double").alias("v")))
    return history.withColumn("_back", back).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["v"]).alias("state"), F.max("date").alias("last_date"))


def _window(rows: int) -> Column:
    return F.slice("state", -rows, rows)


def rolling_stats(rows: int) -> tuple[Column, Column]:
    """Mean and sample deviation of the last values of a state; NULL while the state is shorter."""
    values = _window(rows)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.lit(float(rows))
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    enough = F.size("state") >= rows
    return F.when(enough, mean), F.when(enough, F.sqrt(spread / F.lit(float(rows - 1))))


def state_features(df: DataFrame, day: date | Column) -> DataFrame:
    """The features of a future day from the state array; the same names and values as
    `series.model_features` gives for a row appended to the history."""
    size = F.size("state")

    def lag(k: int) -> Column:
        return F.when(size >= k, F.try_element_at("state", F.lit(-k)))

    made: dict[str, Column] = {f"lag_{k}": lag(k) for k in series.LAGS}
    stats = {n: rolling_stats(n) for n in series.WINDOWS}
    for n, (mean, std) in stats.items():
        made |= {f"rolling_mean_{n}": mean, f"rolling_std_{n}": std}
    df = df.withColumns(made).withColumn("date", F.lit(day))
    second: dict[str, Column] = {
        "trend_1d": lag(1) - lag(2), "trend_7d": lag(1) - lag(7), "trend_14d": lag(1) - lag(14),
        "trend_ratio_7d": ratio(lag(1), lag(7)), "trend_ratio_14d": ratio(lag(1), lag(14)),
        "trend_acceleration": (lag(1) - lag(7)) - (lag(1) - lag(14)),
    }
    for n in series.WINDOWS:
        second[f"volatility_{n}"] = F.col(f"rolling_std_{n}")
        second[f"coefficient_variation_{n}"] = ratio(f"rolling_std_{n}", f"rolling_mean_{n}")
    for n in (3, 7, 14):
        second[f"order_velocity_{n}d"] = F.col(f"rolling_mean_{n}")
    second["order_velocity_change"] = F.col("rolling_mean_3") - F.col("rolling_mean_14")
    return df.withColumns(second).transform(calendar.time_features).transform(calendar.seasonality)


def recursive_forecast(model: PipelineModel, history: DataFrame, start: date | DataFrame, horizon: int = 7,
                       target: str = "quantity_sold", keys=SERIES) -> DataFrame:
    """(keys, date, horizon, prediction) for D+1 .. D+h of all series at once.

    Each step scores one row per series and appends the prediction to its state. Steps depend
    on each other, so the small state is stored between them. A series with too short a
    history gets NULL instead of stopping the others. `start` is a day, or a table of some of the
    keys with their own `_start`.
    """
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    state = series_state(history, target, keys=keys).select(*keys, "state")
    if isinstance(start, DataFrame):
        state = state.join(start, [k for k in keys if k in start.columns])
    else:
        state = state.withColumn("_start", F.lit(start))
    days = F.sequence("_start", F.date_add("_start", horizon - 1))
    done = forecast_days(model, state.withColumn("days", days), horizon, keys, kept=("days",))
    rows = done.select(*keys, F.posexplode(F.arrays_zip("days", "path")).alias("_step", "_row"))
    return rows.select(*keys, F.col("_row.days").alias("date"), (F.col("_step") + 1).alias("horizon"), F.col("_row.path").alias("prediction"))


def forecast_days(model: PipelineModel, states: DataFrame, steps: int, keys=SERIES, kept=()) -> DataFrame:
    """(keys, kept, path): the forecasts of the dates in `days`, one after the other, from the values in `state`.

    A step beyond a series' days, or without the values it needs, is NULL and leaves the state as it is.
    """
    carried = [*keys, *dict.fromkeys(("days", *kept))]
    state = cut(states.select(*carried, "state")).withColumn("path", F.array().cast("array<double>"))
    for step in range(steps):
        scored = predict(model, state_features(state, F.get("days", F.lit(step))))
        moved = F.concat(F.slice("state", 2, STATE - 1), F.array("prediction"))
        state = cut(scored.select(*carried, F.when(F.col("prediction").isNotNull(), moved).otherwise(F.col("state")).alias("state"),
                                  F.concat("path", F.array("prediction")).alias("path")))
    return state.drop("state")


def future_features(history: DataFrame, future: DataFrame, target: str = "quantity_sold") -> DataFrame:
    """Features of future rows from history only; a future row must not carry its target."""
    if target in future.columns and not future.filter(F.col(target).isNotNull()).isEmpty():
        raise ValueError(f"future rows must not contain {target}")
    asked = future.withColumn(target, F.lit(None).cast("double"))
    relevant = history.join(future.select(*SERIES).distinct(), list(SERIES), "left_semi")
    both = relevant.withColumn("_future", F.lit(False)).unionByName(
        asked.withColumn("_future", F.lit(True)), allowMissingColumns=True)
    return series.model_features(both, target).filter("_future").drop("_future")


def window_features(rows: DataFrame, history: DataFrame, target: str = "quantity_sold", compact: bool = False) -> DataFrame:
    """Features of a window of rows with the preceding history as context; the newer row wins."""
    keys = [*SERIES, "date"]
    both = splits.keep_last(history.select(*keys, target), rows.select(*keys, target), keys)
    featured = series.compact_features(both, target) if compact else series.model_features(both, target)
    return featured.join(rows.select(*keys), keys, "left_semi")


def predict_with_history(model: PipelineModel, rows: DataFrame, history: DataFrame, target: str = "quantity_sold") -> DataFrame:
    """Predict a window of rows with the preceding history as context."""
    return predict(model, window_features(rows, history, target, set(inputs(model)) <= set(series.COMPACT_FEATURES)))


def latest_predictions(predicted: DataFrame, keys=SERIES) -> DataFrame:
    """Per series the last day that has a prediction."""
    known = predicted.filter(F.col("prediction").isNotNull())
    return known.groupBy(*keys).agg(F.max("date").alias("date"), F.max_by("prediction", "date").alias("prediction"))


# --- learning cycle --------------------------------------------------------------------------------

def learning_cycle(reference: DataFrame, current: DataFrame, target: str, features, train_rows: DataFrame, evaluation: DataFrame,
                   champion: PipelineModel | None = None, force: bool = False, min_evaluation_rows: int = 1,
                   columns=series.COMPACT_FEATURES, **training) -> tuple[DataFrame, PipelineModel | None]:
    """Drift, retraining decision, candidate training, champion comparison; the row says what to do.

    The candidate is returned for the caller to save under the path of the current champion.
    """
    for df, name in ((reference, "reference"), (current, "current"), (train_rows, "training rows"), (evaluation, "evaluation")):
        admission.learning_data(df, target, name)
    report = drift.drift_report(reference, current, features)
    decision = drift.retraining_decision(report, current.count(), scheduled=force)
    if not decision.first()["should_retrain"]:
        return decision.withColumn("action", F.lit("KEEP_CHAMPION")), None
    candidate = train(series.compact_features(train_rows, target), columns, target, **training)
    current_champion = champion or candidate
    scored = series.compact_features(evaluation, target)
    scored = predict(current_champion, predict(candidate, scored, "candidate"), "champion")
    verdict = drift.candidate_evaluation(scored, "champion", "candidate", target, min_rows=min_evaluation_rows)
    action = F.when(F.col("passes"), "PROMOTE_CANDIDATE").otherwise("REJECT_CANDIDATE")
    return verdict.withColumn("action", action), candidate


def ablation_features(df: DataFrame, mode: str, target: str = "quantity_sold", text: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Features and column names of one ablation mode."""
    from . import cultural

    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    featured = series.temporal_features(df, target)
    columns = [c for c in featured.columns if c.startswith(("history_", "calendar_"))]
    if mode != "history":
        featured = featured.transform(cultural.known_context).transform(cultural.context_interactions).transform(cultural.static_features)
        columns += [*cultural.KNOWN_CONTEXT, *cultural.INTERACTIONS] + [c for c in featured.columns if c.startswith("entity_")]
    if mode in ("numeric_visual", "multimodal"):
        before = set(featured.columns)
        featured = cultural.visual_features(featured, leakage.visual_columns(df))
        columns += [c for c in featured.columns if c not in before or c in leakage.visual_columns(df)]
    if mode in ("numeric_text", "multimodal") and text is not None:
        names = [c for c in text.columns if c.startswith("text_")]
        featured = featured.join(text, ["outlet_id", "product_id", "date"], "left").fillna(0.0, names)
        columns += names
    return featured.fillna(0.0, columns), columns


MODES = ("history", "numeric", "numeric_text", "numeric_visual", "multimodal")


def ablation(df: DataFrame, modes=MODES, target: str = "quantity_sold", validation_days: int = 30,
             test_days: int = 30, text: DataFrame | None = None, **training) -> DataFrame:
    """Test metrics per mode: fit on train and validation rows, measured on the last days.

    The modes differ in their columns only and are fitted at the same time.
    """
    df = cut(df)

    def measure(mode: str) -> DataFrame:
        featured, columns = ablation_features(df, mode, target, text)
        labelled = splits.last_days_split(cut(featured), validation_days, test_days)
        model = train(labelled.filter("split <> 'test'"), columns, target, loss="absolute", **training)
        test = predict(model, labelled.filter("split = 'test'"))
        measured = metrics.ablation_metrics(cut(test), target, "prediction")
        return cut(measured.select(F.lit(mode).alias("mode"), F.lit(len(columns)).alias("features"), *[F.col(c).alias(f"test_{c}") for c in measured.columns]))

    with ThreadPoolExecutor(len(modes)) as pool:
        rows = list(pool.map(inheritable_thread_target(df.sparkSession)(measure), modes))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out

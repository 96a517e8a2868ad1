"""Rolling-origin comparison of baselines and trained trees.

A fold is an origin: the last rows of every series behind it are held out and forecast from what
lies before. Folds are expanded once, from one grouping of the history; the trees of a fold are
fitted on feature rows before its origin, all folds at the same time, and forecast the held-out
days recursively, so every model sees the same days.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SERIES
from ..plans.lineage import cut
from . import baselines, models, series

TREES = "boosted_trees"


def folds(df: DataFrame, origins: int = 2, horizon: int = 7, target: str = "quantity_sold", keys=SERIES) -> DataFrame:
    """(keys, origin, state, days, actual): per fold the history's tail and the held-out days; origin 0 is the latest.

    A series takes part in a fold if it has a row before the origin.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))

    def piece(skip: int, length: int, value: str):
        inside = F.when((F.col("_back") > skip) & (F.col("_back") <= skip + length), F.struct((-F.col("_back")).alias("o"), F.col(value).alias("v")))
        return F.transform(F.array_sort(F.collect_list(inside)), lambda x: x["v"])

    made = [F.struct(F.lit(o).alias("origin"), piece((o + 1) * horizon, models.STATE, "_value").alias("state"), piece(o * horizon, horizon, "date").alias("days"),
                     piece(o * horizon, horizon, "_value").alias("actual")) for o in range(origins)]
    rows = df.select(*keys, "date", F.col(target).cast("double").alias("_value")).withColumn("_back", back)
    return rows.groupBy(*keys).agg(F.array(*made).alias("_folds")).select(*keys, F.inline("_folds")).filter(F.size("state") > 0)


def _long(forecast: DataFrame, name: str, keys) -> DataFrame:
    """One row per held-out day of forecasts kept as an array."""
    steps = forecast.select(*keys, "origin", F.posexplode(F.arrays_zip("days", "actual", "path")).alias("_at", "_row"))
    return steps.select(*keys, "origin", (F.col("_at") + 1).alias("horizon"), F.col("_row.days").alias("date"), F.lit(name).alias("model_name"),
                        F.col("_row.actual").alias("actual"), F.col("_row.path").alias("predicted"))


def baseline_folds(made: DataFrame, methods=baselines.METHODS, keys=SERIES) -> DataFrame:
    """The baselines' forecasts of every fold."""
    steps = F.sequence(F.lit(1), F.size("actual"))
    out = None
    for method in methods:
        path = F.transform(steps, lambda h: baselines.forecast_value(method, F.col("state"), h))
        one = _long(made.withColumn("path", path), method, keys)
        out = one if out is None else out.unionByName(one)
    return out


def tree_folds(df: DataFrame, made: DataFrame, origins: int = 2, horizon: int = 7, target: str = "quantity_sold", keys=SERIES, **training) -> DataFrame:
    """The trees' forecasts of every fold; a series with too short a tail for the features has none."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    featured = cut(series.model_features(df, target, keys).withColumn("_back", back))

    def one(origin: int) -> DataFrame:
        model = models.train(featured.filter(F.col("_back") > (origin + 1) * horizon), series.MODEL_FEATURES, target, **training)
        mine = made.filter(F.col("origin") == origin)
        return models.forecast_days(model, mine, horizon, (*keys, "origin"), kept=("days", "actual"))

    with ThreadPoolExecutor(max(1, origins)) as pool:  # the fits are jobs of one session; its scheduler shares the cluster among them
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(origins)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _long(out, TREES, keys).filter("predicted IS NOT NULL")


def compare(df: DataFrame, origins: int = 2, horizon: int = 7, target: str = "quantity_sold", keys=SERIES, methods=baselines.METHODS, **training) -> DataFrame:
    """(keys, origin, horizon, date, model_name, actual, predicted) of baselines and trees."""
    df = cut(df.select(*keys, "date", target))
    made = cut(folds(df, origins, horizon, target, keys))
    return baseline_folds(made, methods, keys).unionByName(tree_folds(df, made, origins, horizon, target, keys, **training))


def in_order(rows: DataFrame, horizon: int = 7) -> DataFrame:
    """The days of all folds numbered through, oldest first, as the order of one test window."""
    return rows.withColumn("step", F.col("horizon") - F.col("origin") * horizon)

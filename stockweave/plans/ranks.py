"""Ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .slices import SLICE_ROWS, before, sliced

HOT_SHARE = 1000


def rank_all(df: DataFrame, score: str, name: str, method: str = "dense", descending: bool = True,
             stored: bool = False, rows: int = SLICE_ROWS) -> DataFrame:
    """Add the rank of `score` over all rows: "dense", or "min" (1 + number of better rows).

    Every distinct value is ranked once, however often it occurs, inside its range (`slices`) and
    after the ranges before. A value that one row in HOT_SHARE has would bring its rows together in
    the join back; there are at most HOT_SHARE such values, and they are joined by broadcast.
    `stored` says that df is already cheap to read again. NULL scores get NULL.
    """
    df = df if stored else cut(df)
    counted = (df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_score"))
                 .agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1)))
    parts = sliced(counted, ["_score"], rows)
    weight = "one" if method == "dense" else "n"
    direction = F.desc if descending else F.asc
    earlier = Window.partitionBy("slice").orderBy(direction("_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (parts.withColumn("inside", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
              .join(before(parts, weight, descending=descending).select("slice", "before"), "slice")
              .select("_score", "n", (F.col("before") + F.col("inside") + 1).alias(name)))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT_SHARE >= total
    ranked = cut(ranked.withColumn("hot", is_hot))
    hot = F.broadcast(ranked.filter("hot").select(F.col("_score").alias("_hot_score"), F.col(name).alias("_hot_rank")))
    marked = df.join(hot, F.col(score) == F.col("_hot_score"), "left")
    # Rows of a hot value or without one look for nothing, dealt out so that they do not meet in one task.
    looks = F.col("_hot_rank").isNull() & F.col(score).isNotNull()
    key = F.when(looks, F.col(score).cast("double")).otherwise(F.monotonically_increasing_id().cast("double"))
    rare = ranked.filter("NOT hot").select(F.lit(True).alias("_found"), F.col("_score").cast("double").alias("_score"), F.col(name).alias("_rare_rank"))
    marked = marked.withColumns({"_looks": looks, "_key": key})
    joined = marked.join(rare, (F.col("_looks") == F.col("_found")) & (F.col("_key") == F.col("_score")), "left")
    return joined.select(*df.columns, F.coalesce("_hot_rank", "_rare_rank").alias(name))


def dense_rank_all(df: DataFrame, score: str, name: str, descending: bool = True, **options) -> DataFrame:
    return rank_all(df, score, name, "dense", descending, **options)

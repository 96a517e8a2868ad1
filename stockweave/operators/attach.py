"""Texts and images as of a day: what was known of an outlet when a row of its series was made.

Items carry an outlet and a day. Of several on one day the last by id counts, so an outlet has one
item a day at most, whatever a table holds; a series day takes the newest item that is not later.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .text_matrix import TextMatrix


def as_of(days: DataFrame, items: DataFrame, key: str, order: str, by=("outlet_id",), date: str = "date") -> DataFrame:
    """`days` (by, date, distinct) with the columns of the newest item of `items` (by, date, key, ...) not later than the day.

    `order` settles several items of a day. A day without an earlier item has NULL.
    """
    values = [c for c in items.columns if c not in (*by, date)]
    daily = items.groupBy(*by, date).agg(F.max_by(F.struct(*values), order).alias("_item"))
    # Days and items in one sequence: both are bounded by the calendar.
    both = days.select(*by, date, F.lit(True).alias("_asked")).unionByName(daily.select(*by, date, "_item"), allowMissingColumns=True)
    merged = both.groupBy(*by, date).agg(F.max("_asked").alias("_asked"), F.max("_item").alias("_item"))
    seen = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("_seen", F.last("_item", ignorenulls=True).over(seen)).filter("_asked").select(
        *by, date, *[F.col(f"_seen.{v}").alias(v) for v in values])


def text_features(notes: DataFrame, train_until, text: str = "text", date: str = "date") -> tuple[DataFrame, TextMatrix]:
    """Notes with text_0.. from a term matrix fitted on the notes up to a day."""
    notes = cut(notes)
    matrix = TextMatrix.fit(notes.filter(F.col(date) <= F.lit(train_until)), text)
    return matrix.transform(notes, text).drop(text), matrix


def image_features(images: DataFrame, train_until, vector: str = "embedding", dimensions: int = 4, date: str = "date", prefix: str = "image_") -> DataFrame:
    """Images with their vector reduced to the principal directions of those up to a day; vectors of another length are left out."""
    known = images.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    known = cut(known.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("_n", F.size(vector)))
    past = known.filter(F.col(date) <= F.lit(train_until))
    usual = past.groupBy("_n").count().orderBy(F.desc("count"), "_n").first()
    if usual is None:
        return known.drop("_v", "_n", vector)
    same = known.filter(F.col("_n") == usual["_n"])
    model = PCA(k=min(dimensions, usual["_n"]), inputCol="_v", outputCol="_p").fit(past.filter(F.col("_n") == usual["_n"]))
    places = vector_to_array(F.col("_p"))
    made = model.transform(same)
    return made.withColumns({f"{prefix}{i}": F.get(places, F.lit(i)) for i in range(min(dimensions, usual["_n"]))}).drop("_v", "_n", "_p", vector)

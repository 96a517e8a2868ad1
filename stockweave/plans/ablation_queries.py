"""Queries: texts and images attached as of a day, the five ablation modes, the decision that follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attach, ensemble, models, validators
from ..sources import demand_tables as src
from .feature_queries import KEY, with_context
from .lineage import cut
from .registry import cte, query

# Documents and embeddings belong to an outlet and a day by their id; ids run through the outlets and then through the days.
cte("spread", "SELECT (SELECT count(*) FROM nation) AS outlets, min(date) AS first_day, datediff('day', min(date), max(date)) + 1 AS days FROM facts", "facts")
cte("notes", """
SELECT n_name AS outlet_id, first_day + CAST((doc_id * 37) % days AS INTEGER) AS date, doc_id FROM documents, spread JOIN nation ON n_nationkey = doc_id % outlets""", "spread")
cte("images", """
SELECT n_name AS outlet_id, first_day + CAST((vec_id * 53) % days AS INTEGER) AS date, vec_id FROM embeddings, spread JOIN nation ON n_nationkey = vec_id % outlets""", "spread")


def placed(spark, sf, facts, table: str, key: str, step: int):
    """A table's rows with the outlet and day of their id."""
    nation = src.table(spark, sf, "nation").select((F.col("n_nationkey")).alias("_place"), F.col("n_name").alias("outlet_id"))
    span = facts.agg(F.min("date").alias("_first"), (F.date_diff(F.max("date"), F.min("date")) + 1).alias("_days"))
    outlets = src.table(spark, sf, "nation").agg(F.count(F.lit(1)).alias("_outlets"))
    rows = src.table(spark, sf, table).join(F.broadcast(span), F.lit(True)).join(F.broadcast(outlets), F.lit(True))
    day = F.date_add("_first", ((F.col(key) * step) % F.col("_days")).cast("int"))
    return rows.withColumn("date", day).withColumn("_place", F.col(key) % F.col("_outlets")).join(nation, "_place").drop("_first", "_days", "_outlets", "_place")


def series_days(facts):
    return facts.select("outlet_id", "date").distinct()


@query("attached_items", "outlet_id date:d doc_id:i vec_id:i", """
WITH days AS (SELECT DISTINCT outlet_id, date FROM facts),
n AS (SELECT outlet_id, date, max(doc_id) AS doc_id FROM notes GROUP BY 1, 2), i AS (SELECT outlet_id, date, max(vec_id) AS vec_id FROM images GROUP BY 1, 2)
SELECT days.outlet_id, days.date, n.doc_id, i.vec_id FROM days ASOF LEFT JOIN n ON days.outlet_id = n.outlet_id AND days.date >= n.date
ASOF LEFT JOIN i ON days.outlet_id = i.outlet_id AND days.date >= i.date""".replace("WITH days", "SELECT * FROM (WITH days") + ") x", ("facts", "notes", "images"))
def _(spark, sf):
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date"))
    days = cut(series_days(facts))
    notes = placed(spark, sf, facts, "documents", "doc_id", 37).select("outlet_id", "date", "doc_id")
    images = placed(spark, sf, facts, "embeddings", "vec_id", 53).select("outlet_id", "date", "vec_id")
    return attach.as_of(days, notes, "doc_id", "doc_id").join(attach.as_of(days, images, "vec_id", "vec_id"), ["outlet_id", "date"])


def multimodal(spark, sf):
    """Facts with context and image columns, and the text columns of every series day."""
    facts = cut(with_context(spark, sf))
    until = facts.agg(F.date_sub(F.max("date"), 60)).first()[0]  # the days before validation and test
    days = cut(series_days(facts))
    notes, _matrix = attach.text_features(placed(spark, sf, facts, "documents", "doc_id", 37).select("outlet_id", "date", "doc_id", "text"), until)
    images = attach.image_features(placed(spark, sf, facts, "embeddings", "vec_id", 53).select("outlet_id", "date", "vec_id", "embedding"), until)
    seen = attach.as_of(days, images, "vec_id", "vec_id").drop("vec_id")
    read = attach.as_of(days, notes, "doc_id", "doc_id").drop("doc_id")
    return facts.join(seen, ["outlet_id", "date"], "left"), facts.select(*KEY.replace(":d", "").split()).join(read, ["outlet_id", "date"])


def results(spark, sf):
    df, text = multimodal(spark, sf)
    return cut(models.ablation(df, text=cut(text)))


@query("gbt_ablation", "mode features:i test_mae:6 test_rmse:6 test_smape:6 test_bias:6 test_high_demand_mae:6 test_spike_recall:6")
def _(spark, sf):
    """All five modes; values of the trees have no SQL."""
    return results(spark, sf)


@query("ablation_decisions", "candidate verdict:b")
def _(spark, sf):
    """Whether each richer mode is adopted over history, from the measured modes, and whether the results keep their rules."""
    measured = results(spark, sf)
    broken = validators.ablation_rules(measured).filter("violations > 0").count()
    rows = None
    for mode in models.MODES[1:]:
        one = ensemble.adoption_decision(measured, mode).select(F.lit(mode).alias("candidate"), (F.col("decision") == "ADOPT").alias("verdict"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(spark.createDataFrame([("rules kept", broken == 0)], "candidate string, verdict boolean"))

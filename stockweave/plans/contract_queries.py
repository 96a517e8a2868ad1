"""Queries: gates on damaged inputs, feature contracts, future rows, stored tables and reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import admission, cultural, daily, leakage, models, scenario, series, splits, validators
from ..sources import demand_tables as src, readers
from . import decision_queries
from .decision_queries import ACTION_SQL, ACTIONS
from .feature_queries import DATE_PARTS, KEY, over_facts, with_context
from .lineage import cut, shared_folder
from .oracle_parts import lag, roll
from .registry import cte, query

Q = "quantity_sold"

# --- gates: orders as a client table, damaged in several ways ---------------------------------------------

cte("damaged", """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'soon' WHEN o_orderkey % 101 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date,
  'C' || (o_custkey % 20) AS outlet_id, o_orderpriority AS product_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' WHEN o_orderkey % 89 = 0 THEN CAST(-floor(o_totalprice / 1000) - 1 AS VARCHAR) ELSE CAST(floor(o_totalprice / 1000) AS VARCHAR) END AS quantity_sold
FROM orders""")


def damaged(spark, sf):
    key, amount = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 1000)
    return src.table(spark, sf, "orders").select(
        F.when(key % 97 == 0, "soon").when(key % 101 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("outlet_id"), F.col("o_orderpriority").alias("product_id"),
        F.when(key % 50 == 0, "n/a").when(key % 89 == 0, (-amount - 1).cast("string")).otherwise(amount.cast("string")).alias("quantity_sold"))


cte("damage_counts", """
SELECT count(*) FILTER (date = 'soon' OR date IS NULL) AS days, count(*) FILTER (date IS NULL) AS null_days,
  count(*) FILTER (quantity_sold = 'n/a') AS texts, count(*) FILTER (date <> 'soon' AND quantity_sold LIKE '-%') AS negatives FROM damaged""", "damaged")


@query("gate_outcomes", "gate input admitted:b reason", """
SELECT gate, input, reason IS NULL AS admitted, reason FROM (
  SELECT unnest([
    {'gate': 'feed', 'input': 'damaged', 'reason': 'negative quantity_sold:' || negatives},
    {'gate': 'feed', 'input': 'sound', 'reason': NULL},
    {'gate': 'history', 'input': 'damaged', 'reason': 'invalid date:' || days || ', invalid quantity_sold:' || texts},
    {'gate': 'history', 'input': 'sound', 'reason': NULL},
    {'gate': 'training', 'input': 'damaged', 'reason': 'null date:' || null_days},
    {'gate': 'training', 'input': 'none', 'reason': 'empty'},
    {'gate': 'training', 'input': 'sound', 'reason': NULL},
    {'gate': 'prepared', 'input': 'damaged', 'reason': NULL},
    {'gate': 'prepared', 'input': 'none', 'reason': 'no complete row'},
    {'gate': 'learning', 'input': 'damaged', 'reason': NULL},
    {'gate': 'learning', 'input': 'none', 'reason': 'empty'},
    {'gate': 'learning', 'input': 'narrow', 'reason': 'missing product_id'},
    {'gate': 'calendar', 'input': 'none', 'reason': 'empty'},
    {'gate': 'calendar', 'input': 'sound', 'reason': NULL}], recursive := true) FROM damage_counts) a""", "damage_counts")
def _(spark, sf):
    table = cut(damaged(spark, sf))
    sound = table.filter("date <> 'soon' AND quantity_sold <> 'n/a' AND NOT startswith(quantity_sold, '-')")
    inputs = {"damaged": table, "sound": sound, "none": table.filter("outlet_id = ''"), "narrow": table.drop("product_id")}
    gates = {"feed": readers.canonical_feed, "history": lambda df: admission.strict_history(df, Q), "training": admission.training_input,
             "prepared": admission.prepared_history, "learning": lambda df: admission.learning_data(df, Q, "rows"), "calendar": admission.calendar_input}
    tried = {"feed": ("damaged", "sound"), "history": ("damaged", "sound"), "training": ("damaged", "none", "sound"), "prepared": ("damaged", "none"),
             "learning": ("damaged", "none", "narrow"), "calendar": ("none", "sound")}
    rows = []
    for gate, names in tried.items():
        for name in names:
            try:
                gates[gate](inputs[name])
                rows.append((gate, name, True, None))
            except admission.Refused as refused:
                rows.append((gate, name, False, ", ".join(refused.written())))
    return spark.createDataFrame(rows, "gate string, input string, admitted boolean, reason string")


@query("gate_violations", "rule violations:i rows:i", """
SELECT unnest(['invalid date', 'invalid quantity_sold', 'negative quantity_sold']) AS rule,
  unnest([count(*) FILTER (try_cast(date AS DATE) IS NULL), count(*) FILTER (try_cast(quantity_sold AS DOUBLE) IS NULL),
          count(*) FILTER (try_cast(quantity_sold AS DOUBLE) < 0)]) AS violations, count(*) AS rows FROM damaged""", "damaged")
def _(spark, sf):
    number = F.col(Q).try_cast("double")
    return admission.violations(damaged(spark, sf), {
        "invalid date": F.col("date").try_cast("date").isNull(), "invalid quantity_sold": number.isNull(), "negative quantity_sold": number < 0})


@query("prepared_history", "outlet_id product_id date:d rows:i quantity:4", """
SELECT outlet_id, product_id, CAST(date AS DATE) AS date, count(*) AS rows, sum(CAST(quantity_sold AS DOUBLE)) AS quantity
FROM damaged WHERE try_cast(date AS DATE) IS NOT NULL AND quantity_sold <> 'n/a' GROUP BY 1, 2, 3""", "damaged")
def _(spark, sf):
    rows = admission.prepared_history(damaged(spark, sf))
    return rows.groupBy("outlet_id", "product_id", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum(Q).alias("quantity"))


# --- feature contracts ------------------------------------------------------------------------------------------

NAMES = ("quantity_sold", "closing_stock", "holiday_importance", "event_active", "temperature", "precipitation", "outlet_id", "revenue",
         "image_light", "embedding_norm", "stockout_event_day", "lost_demand_rate")


def named(spark, sf):
    """Facts under names of every class, some of them without any value."""
    facts = src.context_facts(src.daily_facts(spark, sf))
    return facts.withColumns({"image_light": F.col("discount") / 10, "embedding_norm": F.lit(None).cast("double"), "stockout_event_day": F.lit(0.0),
                              "lost_demand_rate": F.col("quantity_sold") * 0})


@query("column_classes", "column present:i forbidden:b context:b visual:b spike_feature:b", f"""
SELECT column_name AS "column", present, forbidden, NOT forbidden AND regexp_matches(column_name, 'holiday|event|temperature|temp|precipitation|rain') AS context,
  NOT forbidden AND regexp_matches(column_name, 'image_|embedding_') AS visual,
  column_name NOT IN ('outlet_id', 'product_id', 'date', 'quantity_sold', 'revenue', 'closing_stock') AS spike_feature
FROM (SELECT *, column_name IN ('quantity_sold', 'closing_stock') OR regexp_matches(column_name, 'stockout_event|lost_demand|closing_stock') AS forbidden
  FROM (SELECT unnest({list(NAMES)}) AS column_name, unnest([count(quantity_sold), count(closing_stock), count(holiday_importance), count(event_active),
    count(temperature), count(precipitation), count(outlet_id), count(revenue), count(discount), 0, count(*), count(quantity_sold)]) AS present
    FROM context_facts) a) b""", "context_facts")
def _(spark, sf):
    df = named(spark, sf).select(*NAMES)
    numbers, texts = leakage.context_columns(df)
    visual, spikes, bad = leakage.visual_columns(df), leakage.spike_feature_columns(df), leakage.firewall_violations(df.columns)
    one = df.agg(*[F.count(c).alias(c) for c in NAMES])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).alias("present"), F.lit(c in bad).alias("forbidden"), F.lit(c in numbers + texts).alias("context"),
        F.lit(c in visual).alias("visual"), F.lit(c in spikes).alias("spike_feature")) for c in NAMES])))


@query("feature_matrix", "rows:i quantity:4 stock:4 unparsed:i", """
SELECT count(*) AS rows, sum(quantity_sold) AS quantity, sum(closing_stock) FILTER (closing_stock <> 0) AS stock,
  count(*) FILTER (closing_stock = 0) AS unparsed FROM facts""", "facts")
def _(spark, sf):
    text = F.when(F.col("closing_stock") == 0, "none").otherwise(F.col("closing_stock").cast("string"))
    matrix = leakage.feature_matrix(src.daily_facts(spark, sf).withColumn("stock", text), [Q, "stock"])
    return matrix.agg(F.count(F.lit(1)).alias("rows"), F.sum(Q).alias("quantity"), F.sum("stock").alias("stock"),
                      F.count_if(F.col("stock").isNull()).alias("unparsed"))


@query("visual_features", "vec_id:i image_0:6 image_1:6 columns:i",
       "SELECT vec_id, coalesce(embedding[1], 0) AS image_0, coalesce(embedding[2], 0) AS image_1, 3 AS columns FROM embeddings")
def _(spark, sf):
    vectors = src.table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("image_0"),
                                                        F.get("embedding", F.lit(1)).alias("image_1"), F.lit(None).cast("float").alias("image_none"))
    made = cultural.visual_features(vectors, leakage.visual_columns(vectors))
    return made.withColumn("columns", F.lit(len(made.columns)))


@query("visual_proxies", f"{KEY} visual_available:4 visual_quality:4",
       "SELECT outlet_id, product_id, date, 0 AS visual_available, 0 AS visual_quality FROM facts", "facts")
def _(spark, sf):
    facts = src.daily_facts(spark, sf)
    return cultural.visual_features(facts, leakage.visual_columns(facts))


@query("scenario_totals", "scenario_name multiplier:6 demand:4", """
SELECT scenario_name, multiplier, multiplier * (SELECT sum(quantity_sold) FROM facts) AS demand
FROM (VALUES ('calm', 1.0), ('festival', 1.2 * 1.5), ('storm', 0.7 * 1.1 * 0.9)) s(scenario_name, multiplier)""", "facts")
def _(spark, sf):
    asked = {"calm": {}, "festival": {"promotion_multiplier": 1.2, "event_multiplier": 1.5},
             "storm": {"weather_multiplier": 0.7, "holiday_multiplier": 1.1, "tourism_multiplier": 0.9}}
    total = src.daily_facts(spark, sf).agg(F.sum(Q).alias("total"))
    pairs = [F.struct(F.lit(name).alias("scenario_name"), F.lit(scenario.combined_multiplier(m)).alias("multiplier")) for name, m in asked.items()]
    return total.select("total", F.inline(F.array(*pairs))).withColumn("demand", F.col("total") * F.col("multiplier"))


_VALUES = {f"lag_{k}": lag(Q, k) for k in series.LAGS} | {f"rolling_{n}_{k}": roll(Q, k, f) for k in series.WINDOWS for n, f in (("mean", "avg"), ("std", "stddev_samp"))}
# On one day of the month each, one value is one too high, is missing, or is the day's own.
_DAMAGE = {"lag_7": ("day(date) = 3", "{} + 1"), "rolling_mean_14": ("day(date) = 5", "NULL"), "lag_1": ("day(date) = 7", "quantity_sold"), "rolling_std_28": ("day(date) = 9", "{} * 1.01")}


def _audited(name: str) -> str:
    day, wrong = _DAMAGE.get(name, ("FALSE", "{}"))
    made = f"CASE WHEN {day} THEN {wrong.format('e')} ELSE e END"
    return (f"""SELECT '{name}' AS "check", count(*) FILTER (NOT coalesce(abs(v - e) <= 1e-8 + 1e-5 * abs(e), v IS NULL AND e IS NULL)) AS violations """
            f"FROM (SELECT *, {made} AS v FROM (SELECT date, quantity_sold, {_VALUES[name]} AS e FROM facts) a) b")


@query("leaked_audit_report", "check violations:i passed:b", f"""
SELECT *, violations = 0 AS passed FROM ({" UNION ALL ".join(map(_audited, _VALUES))}
  UNION ALL SELECT 'temporal_split', CASE WHEN max(date) FILTER (date < last - 28) < min(date) FILTER (date >= last - 28) THEN 0 ELSE 1 END
    FROM (SELECT date, max(date) OVER () AS last FROM facts) a
  UNION ALL SELECT 'feature_names', 1 UNION ALL SELECT 'forecast_time_names', 2) c""", "facts")
def _(spark, sf):
    """The audit of a feature table with damaged values, and of inputs among which are two that are known only afterwards."""
    df = series.model_features(src.daily_facts(spark, sf))
    for name, (day, wrong) in _DAMAGE.items():
        df = df.withColumn(name, F.when(F.expr(day), F.expr(wrong.format(name))).otherwise(F.col(name)))
    return leakage.leakage_audit(df, [*series.MODEL_FEATURES, "quantity_sold", "revenue"])


# --- history, future rows, windows ---------------------------------------------------------------------------------

@query("history_before", "outlet_id product_id rows:i last_day:d", """
SELECT outlet_id, product_id, count(*) AS rows, max(date) AS last_day FROM facts WHERE date < DATE '2000-03-01' GROUP BY 1, 2""", "facts")
def _(spark, sf):
    import datetime

    return splits.before(src.daily_facts(spark, sf), datetime.date(2000, 3, 1)).groupBy("outlet_id", "product_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("date").alias("last_day"))


@query("future_features", f"{KEY} day_of_week:i lag_1:6 lag_7:6 rolling_mean_7:6 rolling_std_28:6 trend_7d:6", f"""
SELECT outlet_id, product_id, date, isodow(date) - 1 AS day_of_week, lag_1, lag_7, rolling_mean_7, rolling_std_28, lag_1 - lag_7 AS trend_7d
FROM (SELECT *, {lag(Q, 1)} AS lag_1, {lag(Q, 7)} AS lag_7, {roll(Q, 7, "avg")} AS rolling_mean_7, {roll(Q, 28, "stddev_samp")} AS rolling_std_28
  FROM (SELECT outlet_id, product_id, date, quantity_sold, FALSE AS future FROM facts
        UNION ALL SELECT outlet_id, product_id, max(date) + 1, NULL, TRUE FROM facts GROUP BY 1, 2 HAVING count(*) % 2 = 0) a) b WHERE future""", "facts")
def _(spark, sf):
    history = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", Q))
    future = history.groupBy("outlet_id", "product_id").agg(F.date_add(F.max("date"), 1).alias("date"), F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    return models.future_features(history, future.drop("n"))


@query("window_features", f"{KEY} lag_1:6 lag_28:6 rolling_mean_7:6", f"""
SELECT * FROM (SELECT outlet_id, product_id, date, {lag("q", 1)} AS lag_1, {lag("q", 28)} AS lag_28, {roll("q", 7, "avg", 1)} AS rolling_mean_7
FROM (SELECT *, CASE WHEN date >= (SELECT max(date) - 30 FROM facts) THEN quantity_sold + 1 ELSE quantity_sold END AS q FROM facts) a) b
WHERE date >= (SELECT max(date) - 30 FROM facts)""", "facts")
def _(spark, sf):
    """A window of rows with the preceding history; in the window the newer value of a day wins."""
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", Q))
    last = facts.agg(F.date_sub(F.max("date"), 30)).first()[0]
    return models.window_features(facts.filter(F.col("date") >= F.lit(last)).withColumn(Q, F.col(Q) + 1), facts, compact=True)


# --- stored tables and reports --------------------------------------------------------------------------------------

@query("processed_dataset", f"{KEY} " + " ".join(f"{c}:i" for c in DATE_PARTS), over_facts(DATE_PARTS), "facts")
def _(spark, sf):
    """Written as CSV, read with a schema, stored as parquet, cleaned and given date parts on the way to the processed area."""
    base = f"{shared_folder(spark)}/stockweave-tables-{uuid4().hex}"
    facts = src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", Q)
    facts.write.option("header", True).csv(f"{base}/raw")
    read = readers.read_csv(spark, f"{base}/raw", "outlet_id string, product_id string, date date, quantity_sold double")
    readers.write_table(read, f"{base}/interim", "facts")
    readers.process_dataset(spark, f"{base}/interim", "facts", f"{base}/processed")
    return readers.read_table(spark, f"{base}/processed", "facts")


@query("stored_features", f"{KEY} lag_1:6 rolling_mean_7:6", f"SELECT outlet_id, product_id, date, {lag(Q, 1)} AS lag_1, {roll(Q, 7, 'avg')} AS rolling_mean_7 FROM facts", "facts")
def _(spark, sf):
    base = f"{shared_folder(spark)}/stockweave-tables-{uuid4().hex}"
    readers.write_table(series.model_features(src.daily_facts(spark, sf)), base, "features", partition_by=("year",))
    return readers.read_file(spark, readers.write_table(readers.read_table(spark, base, "features"), base, "features.parquet"))


@query("report_round_trip", ACTIONS, ACTION_SQL + " WHERE priority <> 'NORMAL'", ("actions", "outlets", "products"))
def _(spark, sf):
    """The daily report written as JSON after its validation, and read again."""
    made = cut(decision_queries.report(spark, sf))
    path = readers.write_report(made, f"{shared_folder(spark)}/stockweave-report-{uuid4().hex}", validators.action_rules(made))
    return decision_queries.flat(readers.read_report(spark, path, made.schema))


cte("cut_short", """
SELECT outlet_id, product_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a
WHERE right(outlet_id, 1) <> '3' OR back <= 20 GROUP BY 1, 2""", "facts")


@query("daily_short_series", "outlet_id product_id priority action recommended_order:2", """
SELECT outlet_id, product_id, CASE WHEN days < 28 THEN 'LOW' ELSE priority END AS priority, CASE WHEN days < 28 THEN 'HISTORY_REQUIRED' ELSE action END AS action,
  CASE WHEN days >= 28 THEN recommended_order END AS recommended_order
FROM (SELECT outlet_id, product_id, n AS days FROM cut_short) s LEFT JOIN actions a USING (outlet_id, product_id)""", ("cut_short", "actions"))
def _(spark, sf):
    """The report where the series of some outlets have 20 days only: they keep their row and get no order."""
    from pyspark.sql import Window

    history = decision_queries.history(spark, sf)
    back = F.row_number().over(Window.partitionBy("outlet_id", "product_id").orderBy(F.desc("date")))
    short = history.withColumn("_back", back).filter("right(outlet_id, 1) <> '3' OR _back <= 20").drop("_back")
    return daily.compact_actions(daily.daily_report(cut(short), src.outlets(spark, sf), src.products(spark, sf), include_normal=True))


@query("daily_action_deep_page", "outlet_id product_id priority shortage:2 position:i page:i total_pages:i", f"""
SELECT *, 3 AS page, (SELECT (count(*) + 24) // 25 FROM actions) AS total_pages
FROM (SELECT *, row_number() OVER ({decision_queries._RANK}) AS position FROM actions) a WHERE position BETWEEN 51 AND 75""", "actions")
def _(spark, sf):
    """Page 3 of all actions from a stored index; no page sorts anything."""
    index = daily.page_index(decision_queries.report(spark, sf, include_normal=True), page_size=25)
    return daily.indexed_page(index, 3)

"""Rolling origins, texts and images as of a day, indexed pages, the shared supply cube."""

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from stockweave.operators import attach, daily, ensemble, leakage, metrics, models, rolling
from stockweave.plans import supply_queries
from stockweave.sources import demand_tables as src

DAY = dt.date(2025, 1, 1)
PAIR = ["outlet_id", "product_id"]


def test_every_model_forecasts_the_same_held_out_days(spark, facts):
    rows = rolling.compare(facts, origins=2, horizon=5, max_iter=2, max_depth=2).collect()
    days = {}
    for r in rows:
        days.setdefault(r.model_name, set()).add((r.outlet_id, r.product_id, r.origin, r.horizon, r.date, r.actual))
    assert days["naive"] == days["seasonal_naive"] and days[rolling.TREES] <= days["naive"]
    assert {r.origin for r in rows} == {0, 1} and all(r.predicted >= 0 for r in rows)
    one = facts.agg(F.min("outlet_id"), F.min("product_id")).first()
    mine = [r.quantity_sold for r in facts.filter((F.col("outlet_id") == one[0]) & (F.col("product_id") == one[1])).orderBy("date").collect()]
    got = {(r.origin, r.horizon): (r.actual, r.predicted) for r in rows if (r.outlet_id, r.product_id, r.model_name) == (*one, "naive")}
    assert got == {(o, h): (mine[len(mine) - (o + 1) * 5 + h - 1], mine[len(mine) - (o + 1) * 5 - 1]) for o in (0, 1) for h in range(1, 6)}
    table = spark.createDataFrame(rows)
    ranked = ensemble.rank_models(metrics.model_scores(rolling.in_order(table, 5), PAIR, "step"), PAIR)
    assert ranked.filter(F.col("model_name") == rolling.TREES).count() > 0


def test_a_short_series_has_no_fold_behind_its_rows(spark):
    rows = spark.createDataFrame([("O", "P", DAY + dt.timedelta(days=i), float(i)) for i in range(8)], "outlet_id string, product_id string, date date, quantity_sold double")
    made = rolling.folds(rows, origins=3, horizon=5).collect()
    assert [(r.origin, r.state, r.actual) for r in made] == [(0, [0.0, 1.0, 2.0], [3.0, 4.0, 5.0, 6.0, 7.0])]


def test_items_as_of_a_day(spark):
    days = spark.createDataFrame([("O", DAY + dt.timedelta(days=i)) for i in (0, 2, 3, 9)] + [("X", DAY)], "outlet_id string, date date")
    items = spark.createDataFrame([("O", DAY + dt.timedelta(days=2), 5, "a"), ("O", DAY + dt.timedelta(days=2), 7, "b"), ("O", DAY + dt.timedelta(days=5), 1, "c"),
                                   ("Y", DAY, 3, "d")], "outlet_id string, date date, id int, word string")
    got = {(r.outlet_id, (r.date - DAY).days): r.word for r in attach.as_of(days, items, "id", "id").collect()}
    assert got == {("O", 0): None, ("O", 2): "b", ("O", 3): "b", ("O", 9): "c", ("X", 0): None}


def test_images_are_projected_on_the_past(spark):
    rows = [("O", DAY + dt.timedelta(days=i), i, [float(i), 2.0 * i, 1.0]) for i in range(10)] + [("O", DAY, 50, None), ("O", DAY, 51, [1.0])]
    images = spark.createDataFrame(rows, "outlet_id string, date date, vec_id int, embedding array<double>")
    made = attach.image_features(images, DAY + dt.timedelta(days=6), dimensions=2)
    got = {r.vec_id: (r.image_0, r.image_1) for r in made.collect()}
    assert set(got) == set(range(10)) and leakage.visual_columns(made) == ["image_0", "image_1"]
    assert abs(abs(got[9][0]) - 9 * 5 ** 0.5) < 1e-6 and abs(got[9][1] - got[0][1]) < 1e-6
    assert attach.image_features(images.filter("vec_id >= 50 AND embedding IS NULL"), DAY).columns == ["outlet_id", "date", "vec_id"]


def test_ablation_modes_differ_in_their_columns(spark, facts):
    df = facts.withColumns({"holiday_importance": F.lit(0.5), "image_0": F.col("quantity_sold") / 3, "image_1": F.lit(1.0)})
    text = facts.select("outlet_id", "product_id", "date", F.lit(0.5).alias("text_0"))
    used = {mode: models.ablation_features(df, mode, text=text)[1] for mode in models.MODES}
    assert set(used["history"]) < set(used["numeric"]) < set(used["numeric_text"]) < set(used["multimodal"])
    assert {"image_0", "image_1"} <= set(used["numeric_visual"]) and "text_0" in used["multimodal"] and "text_0" not in used["numeric_visual"]
    with pytest.raises(ValueError):
        models.ablation_features(df, "everything")


def test_pages_from_the_index_equal_sorted_pages(spark, facts):
    actions = daily.daily_report(facts, src.outlets(spark, SF), src.products(spark, SF), include_normal=True)
    index = daily.page_index(actions, page_size=7, rows=10)
    total = actions.count()
    for page in (1, 2, -(-total // 7)):
        want = daily.action_page(actions, page, 7).select("outlet_id", "product_id", "page", "total_pages", "has_next").collect()
        assert daily.indexed_page(index, page).orderBy("position").select("outlet_id", "product_id", "page", "total_pages", "has_next").collect() == want
    assert daily.indexed_page(index, total).collect() == []
    plan = daily.indexed_page(index, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "PushedFilters: [IsNotNull(position), GreaterThanOrEqual(position,8)" in plan
    assert daily.indexed_page(daily.page_index(actions.limit(0)), 1).count() == 0


def test_supply_scans_the_line_items_once(spark):
    from unittest import mock

    scans = []
    real = src.table
    with mock.patch.object(src, "table", lambda s, d, name: (scans.append(name), real(s, d, name))[1]):
        out = supply_queries.recommendations(spark, SF)
    assert scans.count("lineitem") == 1 and "lineitem" not in out._jdf.queryExecution().toString()
    cube = src.supply_cube(spark, SF)
    assert src.facts_of(cube).select("outlet_id", "product_id", "date", "quantity_sold", "closing_stock", "received_stock").exceptAll(
        src.daily_facts(spark, SF).select("outlet_id", "product_id", "date", "quantity_sold", "closing_stock", "received_stock")).isEmpty()

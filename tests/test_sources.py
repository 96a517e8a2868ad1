"""Files, feeds, JSON requests, reports and the streaming ingest."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF
from stockweave.operators import client, daily, models, series, validators
from stockweave.sources import demand_tables as src, readers
from stockweave.streaming import ingest


def write(path, text):
    with open(path, "w") as handle:
        handle.write(text)


@pytest.fixture
def incoming(tmp_path, spark):
    folder = tmp_path / "incoming"
    folder.mkdir()
    write(folder / "good.csv", "Sale_Date, STORE_ID,sku,Qty\n2025-01-01,S1,A,3\n2025-01-01,S1,A,4\nbad,S1,A,4\n")
    write(folder / "other.csv", "product,quantity,outlet,timestamp\nB,5,S2,2025-01-02 10:00:00\n")
    write(folder / "negative.csv", "date,outlet_id,product_id,quantity_sold\n2025-01-01,S1,A,-1\n2025-01-02,S1,A,2\n")
    write(folder / "partial.csv", "date,outlet_id,quantity_sold\n2025-01-01,S1,1\n")
    write(folder / "empty.csv", "")
    write(folder / "lines.json", json.dumps({"date": "2025-01-03", "store_id": "S3", "sku": "C", "qty": 7}) + "\n")
    return str(folder)


def test_package_reader_maps_every_layout(spark, incoming):
    rows = readers.read_package(spark, incoming)
    assert rows.select("source_file").distinct().count() == 5
    good = readers.canonical_feed(rows.filter(~F.col("source_file").contains("negative")))
    assert {(r["outlet_id"], r["quantity_sold"]) for r in good.collect()} == {("S1", 3.0), ("S1", 4.0), ("S2", 5.0), ("S3", 7.0)}
    with pytest.raises(Exception):
        readers.canonical_feed(rows).collect()


def test_streaming_ingest_accepts_quarantines_and_continues(spark, incoming, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest.start_ingest(spark, incoming, target, checkpoint).awaitTermination()
    seen = {os.path.basename(r["source_file"]): r["reason"] for r in ingest.manifest_table(spark, target).collect()}
    assert seen == {"good.csv": None, "other.csv": None, "lines.json": None, "negative.csv": "NEGATIVE_QUANTITY",
                    "partial.csv": "MISSING_COLUMNS:product_id"}
    sales = {(r["outlet_id"], str(r["date"])): r["quantity_sold"] for r in ingest.sales_table(spark, target).collect()}
    assert sales == {("S1", "2025-01-01"): 7.0, ("S2", "2025-01-02"): 5.0, ("S3", "2025-01-03"): 7.0}
    assert ingest.quarantine_table(spark, target).count() == 3
    assert not os.path.exists(f"{target}/staged/batch=0")
    write(os.path.join(incoming, "later.csv"), "date,outlet_id,product_id,quantity_sold\n2025-01-05,S9,Z,1\n")
    ingest.start_ingest(spark, incoming, target, checkpoint).awaitTermination()
    assert ingest.sales_table(spark, target).count() == 4
    # A batch that runs again replaces its own output.
    files = spark.read.format("binaryFile").load(os.path.join(incoming, "later.csv")).select(
        "path", F.col("_metadata.file_path").alias("source_file"), "length", "modificationTime")
    ingest.write_batch(files, 1, target)
    assert ingest.sales_table(spark, target).count() == 4
    # Rows of a batch that has not written its manifest are not read.
    os.rename(f"{target}/manifest/batch=1", f"{target}/held back")
    assert ingest.sales_table(spark, target).count() == 3


def test_feed_parsing_of_odd_files(spark, tmp_path):
    write(tmp_path / "quoted.csv", '\ufeff"Date" ,outlet_id,"a, b",product_id,QTY\r\n2025-01-01,"O, ""1""",x,"P",5\r\n\n2025-01-02,O2\n')
    write(tmp_path / "header.csv", "date,outlet_id,product_id,quantity_sold\n")
    write(tmp_path / "broken.json", '{"date": "2025-01-01"\n{"Date": "2025-01-03", "outlet": 7, "item": true, "qty": 1.5, "qty2": null}\n')
    spark.range(3).selectExpr("cast(id as int) qty", "'2025-01-01' date", "'a' outlet", "'b' sku").coalesce(1).write.parquet(str(tmp_path / "i"))
    spark.range(2).selectExpr("cast(id as string) qty", "'2025-01-01' date", "'a' outlet", "'b' sku").coalesce(1).write.parquet(str(tmp_path / "s"))
    paths = [str(tmp_path / n) for n in ("quoted.csv", "header.csv", "broken.json")]
    paths += [str(p) for folder in "is" for p in (tmp_path / folder).glob("*.parquet")]
    rows = readers.read_files(spark, paths)
    got = sorted((tuple(r)[:4] for r in rows.collect()), key=str)
    parquet = [("2025-01-01", "a", "b", str(i)) for i in (0, 0, 1, 1, 2)]
    assert got == sorted([("2025-01-01", 'O, "1"', "P", "5"), ("2025-01-02", "O2", None, None), (None, None, None, None),
                          ("2025-01-03", "7", "true", "1.5"), *parquet], key=str)
    with pytest.raises(ValueError):
        readers.read_files(spark, ["x.xlsx"])


def test_json_requests_become_tables(spark):
    body = {"client_id": "c1", "sales": [{"date": "2025-01-01", "outlet_id": "O", "product_id": "P", "quantity_sold": 2},
                                         {"date": "2025-01-01", "outlet_id": "O", "product_id": "P", "quantity_sold": 3},
                                         {"date": "x", "outlet_id": "O", "product_id": "P", "quantity_sold": 3}],
            "inventory": [{"outlet_id": "O", "product_id": "P", "current_inventory": 1.0}], "outlets": [], "products": []}
    tables = readers.request_tables(spark.createDataFrame([(json.dumps(body),)], "value string"))
    (row,) = tables["sales"].collect()
    assert row["quantity_sold"] == 5.0 and tables["inventory"].count() == 1 and tables["outlets"].count() == 0


def test_report_round_trip_and_pages(spark, tmp_path, facts):
    actions = daily.daily_report(facts, src.outlets(spark, SF), src.products(spark, SF), include_normal=True)
    path = readers.write_report(actions, str(tmp_path / "report"), validators.action_rules(actions))
    again = readers.read_report(spark, path, actions.schema)
    assert again.count() == actions.count()
    pages = [daily.action_page(again, page=p, page_size=25).count() for p in (1, 2, 3)]
    assert sum(pages) == min(75, actions.count())
    broken = actions.withColumn("model_confidence", F.lit(2.0))
    with pytest.raises(ValueError):
        readers.write_report(broken, path, validators.action_rules(broken))
    with pytest.raises(ValueError):
        daily.daily_report(facts, src.outlets(spark, SF), src.products(spark, SF), report_date=dt.date(1990, 1, 1))


def test_tables_and_suffixes(spark, tmp_path, facts):
    base = str(tmp_path)
    readers.write_table(facts, base, "facts", partition_by=("outlet_id",))
    assert readers.read_table(spark, base, "facts").count() == facts.count()
    with pytest.raises(ValueError):
        readers.read_file(spark, "x.xlsx")
    assert readers.process_dataset(spark, base, "facts", f"{base}/done").endswith("facts")
    assert "week_of_year" in spark.read.parquet(f"{base}/done/facts").columns


def test_recursive_forecast_covers_every_series(spark, facts):
    history = facts.select("outlet_id", "product_id", "date", "quantity_sold")
    model = models.train(series.model_features(history), series.MODEL_FEATURES, max_iter=2, max_depth=3)
    out = models.recursive_forecast(model, history, daily.latest_day(history) + dt.timedelta(days=1), 3)
    assert out.count() == 3 * history.select("outlet_id", "product_id").distinct().count()
    assert out.filter("prediction < 0 OR prediction IS NULL").count() == 0
    with pytest.raises(ValueError):
        models.recursive_forecast(model, history, dt.date(2025, 1, 1), 5)


def test_client_actions_without_inventory_ask_for_it(spark, facts):
    from stockweave.operators import baselines

    wide = baselines.pivot_horizon(baselines.baseline_forecast(facts, 7, ["naive"]))
    none = spark.createDataFrame([], "outlet_id string, product_id string, current_inventory double")
    out = client.client_actions(wide, facts, none, src.outlets(spark, SF), src.products(spark, SF), include_normal=True)
    assert {r["action"] for r in out.select("action").distinct().collect()} == {"INVENTORY_DATA_REQUIRED"}
    assert client.top_actions(out, 5).count() == 5


def test_short_series_have_a_daily_action(spark, facts):
    first = facts.agg(F.min("outlet_id"), F.min("product_id")).first()
    last = daily.latest_day(facts)
    one = (F.col("outlet_id") == first[0]) & (F.col("product_id") == first[1])
    assert facts.filter(one).count() > 28
    short = facts.filter(~one | (F.col("date") > F.lit(last - dt.timedelta(days=200))))
    left = short.filter(one).count()
    assert 0 < left < 28
    actions = daily.daily_report(short, src.outlets(spark, SF), src.products(spark, SF), include_normal=True)
    rows = daily.compact_actions(actions).collect()
    assert len(rows) == facts.select("outlet_id", "product_id").distinct().count()
    (row,) = [r for r in rows if r.action == "HISTORY_REQUIRED"]
    assert (row.outlet_id, row.product_id) == tuple(first) and row.priority == "LOW" and row.recommended_order is None and row.stockout_risk == "UNKNOWN"
    assert daily.report_summary(actions).first()["history_actions"] == 1
    assert daily.with_history(actions).count() == len(rows) - 1
    assert daily.counts_by(actions, "priority").agg(F.sum("actions")).first()[0] == len(rows)
    assert validators.passed(validators.action_rules(actions))

"""Segments, validators of several layers, context ablation inputs, prediction windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockweave.operators import cultural, drift, leakage, models, quality, segments, selection, series, splits, validators


def performance(spark, n=9):
    rows = [(f"O{i}", *[float((i % 3) * 10 + j + i * 0.01) for j in range(len(segments.FEATURES))]) for i in range(n)]
    return spark.createDataFrame(rows, "outlet_id string, " + ", ".join(f"{c} double" for c in segments.FEATURES))


def test_segments_recover_three_groups_and_pass_their_rules(spark):
    out = segments.outlet_segments(performance(spark), max_clusters=4, restarts=3)
    assert out.count() == 9 and out.select("cluster_id").distinct().count() == 3
    assert {r["cluster_size"] for r in out.collect()} == {3}
    assert validators.passed(validators.segment_rules(out))
    assert not validators.passed(validators.segment_rules(out.withColumn("cluster_size", F.lit(4))))
    with pytest.raises(ValueError):
        segments.outlet_segments(performance(spark, 2))


def test_layers_must_hold_the_same_outlets(spark):
    a, b = performance(spark), performance(spark, 7)
    found = {r["rule"]: r["violations"] for r in validators.same_outlets(a=a, b=b).collect()}
    assert found == {"outlets missing from a": 0, "outlets missing from b": 2}


def test_validators_count_null_as_a_violation(spark):
    df = spark.createDataFrame([("f", None, 0.1, 1.0, 1.0, True)],
                               "feature string, psi double, mean_shift double, reference_mean double, current_mean double, drifted boolean")
    assert not validators.passed(validators.drift_rules(df))
    assert not validators.passed(validators.drift_rules(df.drop("psi")))
    assert not validators.passed(validators.drift_rules(df.filter("feature = 'none'")))


def test_visual_columns_pass_or_become_constant(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "visual_mean_brightness double, image_x string")
    out = cultural.visual_features(df, leakage.visual_columns(df))
    assert [r["visual_mean_brightness"] for r in out.collect()] == [1.0, 0.0]
    assert "image_x" not in out.columns and out.first()["visual_quality"] == 1.0
    none = cultural.visual_features(df.select("image_x"), ["image_x"])
    assert none.first()["visual_available"] == 0.0


def test_advanced_features_hide_forbidden_columns(spark, facts):
    out = leakage.advanced_features(facts)
    assert not {"revenue", "closing_stock"} & set(out.columns)
    report = leakage.advanced_validation(out.drop("discount"))
    assert report["passed"], report["errors"]
    assert leakage.feature_matrix(out).columns == leakage.advanced_feature_columns(out)


def test_prediction_window_uses_history_and_newer_rows_win(spark, facts):
    history = facts.select("outlet_id", "product_id", "date", "quantity_sold")
    labelled = splits.last_days_split(history, 30, 30)
    model = models.train(series.compact_features(history), series.COMPACT_FEATURES, max_iter=2, max_depth=3)
    window = labelled.filter("split = 'test'").drop("split")
    out = models.predict_with_history(model, window, history)
    assert out.count() == window.count()
    assert out.filter("prediction IS NULL").count() == 0
    with pytest.raises(ValueError):
        models.train(series.compact_features(history), ["lag_1", "revenue"])
    with pytest.raises(ValueError):
        models.train(series.compact_features(history.filter("outlet_id = 'none'")), series.COMPACT_FEATURES)


def test_future_rows_with_a_target_are_refused(spark, facts):
    history = facts.select("outlet_id", "product_id", "date", "quantity_sold")
    with pytest.raises(ValueError):
        models.future_features(history, history)


def test_keep_last_and_one_row_catalogs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {(r["k"], r["v"]) for r in splits.keep_last(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_short_history_is_named(spark):
    rows = [("O", "P", dt.date(2025, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "outlet_id string, product_id string, date date, quantity_sold double")
    with pytest.raises(ValueError, match="O"):
        quality.require_history(df)
    assert quality.require_history(df, 10) is df
    assert selection.series_summary(df).first()["recent_growth"] == 0.0


def test_retraining_reasons(spark):
    calm = spark.createDataFrame([("f", False)], "feature string, drifted boolean")
    assert not drift.retraining_decision(calm, 10).first()["should_retrain"]
    row = drift.retraining_decision(calm, 10, error_degradation=0.2, scheduled=True).first()
    assert row["reasons"] == ["error_degradation:0.2000", "scheduled_retraining"]

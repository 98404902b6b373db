"""Metrics, ABC classes, registry and paging."""

from dataclasses import replace

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import dimensions, metrics, registry, serving
from helpers import D, rows


def predictions(spark, data):
    return spark.createDataFrame(data, "Item string, Quantity_Sold double, Predicted double")


def test_metric_values(spark):
    df = predictions(spark, [("a", 10.0, 11.0), ("a", 20.0, 19.0), ("b", 30.0, 33.0), ("b", 1.0, 1.0)])
    row = metrics.forecast_metrics(df.where("Quantity_Sold > 1")).first()
    assert row["wmape"] == 8.33 and row["mae"] == 1.67 and row["n_items"] == 2
    assert row["r2"] == pytest.approx(1 - 11 / 200) and row["volume_accuracy"] == 95.0
    assert row["median_period_accuracy"] == 90.0
    assert row["periods_within_20pct"] == 100.0


def test_periods_below_two_do_not_count(spark):
    row = metrics.forecast_metrics(predictions(spark, [("a", 1.0, 9.0), ("a", 0.0, 1.0)])).first()
    assert (row["median_period_accuracy"], row["periods_within_20pct"], row["periods_within_50pct"]) == (0.0, 0.0, 0.0)


def test_median_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    actual = rng.integers(2, 90, 3001).astype(float)
    forecast = rng.integers(0, 90, 3001).astype(float)
    data = [("hot" if i % 3 else f"i{i}", a, f) for i, (a, f) in enumerate(zip(actual.tolist(), forecast.tolist()))]
    row = metrics.forecast_metrics(predictions(spark, data)).first()
    assert row["median_period_accuracy"] == pytest.approx(np.median(100 * (1 - abs(forecast - actual) / actual)), abs=0.051)


def test_abc_fixture(spark):
    data = [("A", 10.0)] * 70 + [("B", 5.0)] * 20 + [("C", 1.0)] * 10
    df = spark.createDataFrame(data, "Item string, Quantity_Sold double")
    got = {r["Item"]: (round(r["Pct"], 3), r["Class"]) for r in metrics.classify_abc(df).collect()}
    assert got == {"A": (0.864, "B"), "B": (0.988, "C"), "C": (1.0, "C")}
    assert rows(metrics.abc_summary(metrics.classify_abc(df)), "Class") == [
        ("A", 0, 0.0, 0.0), ("B", 1, 700.0, 86.4), ("C", 2, 110.0, 13.6)]


def test_dominant_item_is_not_class_a(spark):
    df = spark.createDataFrame([("big", 80.0), ("x", 12.0), ("y", 8.0)], "Item string, Quantity_Sold double")
    assert {r["Item"]: r["Class"] for r in metrics.classify_abc(df).collect()} == {"big": "B", "x": "C", "y": "C"}


def test_class_metrics_omit_absent_classes(spark):
    df = predictions(spark, [("a", 60.0, 50.0), ("b", 25.0, 25.0), ("c", 15.0, 20.0)])
    classified = metrics.classify_abc(df)
    assert {r["Class"] for r in metrics.class_metrics(df, classified).collect()} == {"A", "B", "C"}
    top = rows(metrics.top_class_a(df, classified))
    assert top == [("a", 60.0, 50.0, 83.3)]
    assert "A" not in {r["Class"] for r in metrics.class_metrics(df.where("Item <> 'a'"), classified).collect()}


def test_top_per_class(spark):
    df = spark.createDataFrame([(f"i{k:03d}", 100.0 - k / 10) for k in range(300)], "Item string, Quantity_Sold double")
    got = metrics.abc_top_per_class(metrics.classify_abc(df), 3)
    assert rows(got.groupBy("Class").agg(F.max("rank"), F.count("*")), "Class") == [("A", 3, 3), ("B", 3, 3), ("C", 3, 3)]


def test_verdicts(spark):
    folds = spark.createDataFrame([(1, 0.9, 20.0, 2.0), (2, 0.7, 22.0, 2.0), (3, 0.6, 25.0, 2.0)], "fold int, r2 double, wmape double, mae double")
    row = metrics.cv_stability(folds).first()
    assert row["high_variance"] and row["degrading"] and row["r2_change"] == pytest.approx(-0.3)


def run_tables(spark):
    stamp = dt.datetime
    runs = spark.createDataFrame(
        [(1, "boosted", stamp(2025, 1, 1), None, 10.0, 1.0, 0.0, 77.0, 1.0, 2.0, True),
         (2, "boosted", stamp(2025, 2, 1), 0.5, 11.0, 1.0, 60.0, 70.0, 1.0, 2.0, False),
         (3, "forest", stamp(2025, 3, 1), 0.4, 12.0, 1.0, None, 71.0, None, 2.0, True)],
        "id int, model_type string, trained_at timestamp, r2 double, wmape double, mae double, median_period_accuracy double, "
        "volume_accuracy double, periods_within_20pct double, periods_within_50pct double, is_active boolean")
    classes = spark.createDataFrame([(1, "A", 2, 9.0, 80.0, None), (2, "A", 2, 9.0, 80.0, 50.0)],
                                    "model_run_id int, abc_class string, n_items long, wmape double, volume_accuracy double, median_period_accuracy double")
    top = spark.createDataFrame([(1, "x", 5.0, 4.0, 80.0), (2, "x", 5.0, 5.0, 100.0)],
                                "model_run_id int, item_name string, quantity_sold double, predicted double, accuracy_pct double")
    forecasts = spark.createDataFrame([(r, i, D(2025, 6, 2), 3.0) for r in (1, 2, 3) for i in (1, 2)],
                                      "model_run_id int, item_id long, date date, quantity_predicted double")
    return registry.RunTables(runs, classes, top, forecasts)


def test_latest_run_and_metrics(spark):
    t = run_tables(spark)
    assert registry.latest_active_run(t.runs).first()["id"] == 3
    assert registry.latest_active_run(t.runs, "boosted").first()["id"] == 1
    assert tuple(registry.run_metrics(t.runs, "boosted").first()) == (0.0, 10.0, 1.0, 0.0, 1.0, 2.0)
    assert tuple(registry.run_metrics(t.runs, "none").first()) == (0.0,) * 6


def test_items_of_the_latest_run(spark):
    tables = run_tables(spark)
    assert registry.items_of_run(replace(tables, item_models=spark.createDataFrame([(1, "A"), (1, "a "), (9, "b")], "model_run_id int, item_name string")), "boosted").collect() == [("a",)]
    runs = tables.runs.withColumn("items_with_models", F.when(F.col("id") == 1, '["Latte Hot", " X "]').when(F.col("id") == 3, "no list"))
    texts = replace(tables, runs=runs)
    assert rows(registry.items_of_run(texts, "boosted"), "item") == [("latte hot",), ("x",)]
    assert registry.items_of_run(texts, "forest").isEmpty() and registry.items_of_run(texts, "none").isEmpty()
    # Rows of the run's own join its text.
    own = spark.createDataFrame([(1, "Tea "), (3, "none"), (1, "x")], "model_run_id int, item_name string")
    assert rows(registry.items_of_run(replace(texts, item_models=own), "boosted"), "item") == [("latte hot",), ("tea",), ("x",)]


def test_summary_falls_back_to_volume_accuracy(spark):
    got = {(r["kind"], r["name"]): r["accuracy"] for r in registry.forecast_summary(run_tables(spark), "boosted").collect()}
    assert got == {("global", None): 77.0, ("class", "A"): 80.0, ("item", "x"): 80.0}
    (none,) = registry.forecast_summary(run_tables(spark), "none").collect()
    assert none["kind"] == "global" and none["n_items"] == 0 and none["accuracy"] == none["periods_within_50pct"] == 0.0


def test_abc_is_stored_by_item_id(spark):
    df = spark.createDataFrame([("a", 60.0), ("b", 30.0), ("zz", 10.0)], "Item string, Quantity_Sold double")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    stored = registry.persisted_abc(metrics.classify_abc(df), items)
    assert rows(stored.drop("computed_at"), "item_id") == [(1, 60.0, 60.0, 0.6, "A"), (2, 30.0, 90.0, 0.9, "B")]
    assert stored.where("computed_at is null").isEmpty()


def test_record_and_cleanup(spark):
    t = run_tables(spark)
    new = t.runs.where("id = 1").withColumn("id", F.lit(4))
    after = registry.record_run(t, new, t.class_metrics.limit(0), t.top_items.limit(0), t.forecasts.limit(0))
    assert rows(after.runs.select("id", "is_active"), "id") == [(1, False), (2, False), (3, True), (4, True)]
    kept, lost = registry.cleanup(after)
    assert lost.first().asDict() == {"deleted_runs": 2, "deleted_class_metrics": 2, "deleted_top_items": 2, "deleted_forecasts": 4}
    assert rows(kept.forecasts.groupBy("model_run_id").count()) == [(3, 2)]
    _, nothing = registry.cleanup(kept)
    assert set(nothing.first()) == {0}


def test_upsert_and_insert(spark):
    have = spark.createDataFrame([(7, "b")], "id long, name string")
    incoming = spark.createDataFrame([("c",), (" a ",), ("b",), ("a",), (None,)], "name string")
    assert rows(dimensions.new_names(have, incoming), "id") == [(8, "a"), (9, "c")]
    empty = have.limit(0)
    assert rows(dimensions.new_names(empty, incoming), "id") == [(1, "a"), (2, "b"), (3, "c")]
    stored = spark.createDataFrame([(D(2025, 1, 1), 1, 5.0)], "date date, item_id long, quantity_sold double")
    more = spark.createDataFrame([(D(2025, 1, 1), 1, 9.0), (D(2025, 1, 2), 1, 2.0)], "date date, item_id long, quantity_sold double")
    assert rows(dimensions.absent_rows(stored, more, ["date", "item_id"])) == [(D(2025, 1, 2), 1, 2.0)]


def test_bom_ids(spark):
    bom = spark.createDataFrame([("T", " x ", "i", "1.5", "gr"), ("T", "y", "i", "some", "gr"), ("U", "z", "i", "2", "gr")],
                                "Tipe string, Item string, Bahan string, Qty string, Unit string")
    cats = spark.createDataFrame([(1, "T")], "id long, name string")
    items = spark.createDataFrame([(5, "x")], "id long, name string")
    got = rows(dimensions.resolve_bom(bom, cats, items).select("item_name", "quantity", "category_id", "item_id"), "item_name")
    assert got == [("x", 1.5, 1, 5), ("z", 2.0, None, None)]


def test_pages(spark):
    df = spark.createDataFrame([(D(2025, 1, 1 + i % 9), f"m{i}", float(i)) for i in range(27)], "date date, raw_material string, quantity_required double")
    second = rows(serving.materials_page(df, "M", "2025-01-02", "2025-01-08", page=2, size=5))
    everything = rows(serving.materials(df, "M", "2025-01-02", "2025-01-08"), "date", "raw_material")
    assert second == everything[5:10] and len(everything) == 21
    assert serving.materials(df, "m1", exact=True).count() == 1
    assert serving.materials_page(df, page=99).count() == 0
    for bad in ({"page": 0}, {"size": 0}, {"size": 1001}):
        with pytest.raises(ValueError):
            serving.materials_page(df, **bad)


def test_far_pages_use_the_distributed_sort(spark):
    df = spark.range(10_000_000).select(F.col("id").alias("date"))
    near = serving.page_of(df, ["date"], 2, 100)._jdf.queryExecution().executedPlan().toString()
    far = serving.page_of(df, ["date"], 20_000, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in near and "TakeOrderedAndProject" not in far

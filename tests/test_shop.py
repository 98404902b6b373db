"""The recurring jobs end to end on a small shop."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom import schemas
from demandloom.forecast.pooled import PooledSettings
from demandloom.operators import features, registry
from demandloom.operators.registry import RunTables
from demandloom.plans import shop
from demandloom.session import materialise
from helpers import D, rows, series_frame


@pytest.fixture(scope="module")
def menu(spark):
    return spark.createDataFrame(
        [("Coffee", "Latte Hot", "milk", "0.2", "l"), ("Coffee", "Latte Hot", "mix", "5", "gr"), ("Tea", "Black", "leaf", "2", "gr")],
        schemas.MENU_BOM)


def test_receipts_to_tables(spark, menu, tmp_path):
    first, second = tmp_path / "one.csv", tmp_path / "two.csv"
    first.write_text("Tanggal;Barang;Kuantitas;Penjualan bersih;Penjualan Kotor\n06/01/25 09.00;latte;2;20.0;22.0\n06/01/25 10.00;Gone;1;1;1\n")
    second.write_text("Date,Item,Modifiers applied,Quantity,Net sales,Gross sales\n1/7/25 9:00 AM,BLACK,,3,9,9\n1/7/25 9:00 AM,Latte,Hot,1,10,11\n")
    lines = materialise(shop.clean_receipts(spark, [str(first), str(second)], menu))
    assert sorted(r["Item"] for r in lines.collect()) == ["Black", "Latte Hot", "Latte Hot"]
    with pytest.raises(ValueError):
        shop.clean_receipts(spark, [str(first)], menu)
    written = shop.write_daily_tables(lines, menu, str(tmp_path / "out"))
    daily = spark.read.parquet(written["daily_item_sales"])
    assert rows(daily.select("Date_Only", "Item", "Category", "Quantity"), "Date_Only", "Item") == [
        (D(2025, 1, 6), "Latte Hot", "Coffee", 2.0), (D(2025, 1, 7), "Black", "Tea", 3.0), (D(2025, 1, 7), "Latte Hot", "Coffee", 1.0)]
    assert spark.read.json(written["transformation_metadata"]).first()["total_days"] == 2
    condiment = spark.createDataFrame([("mix", "10", "gr", "sugar", "4", "gr")], schemas.CONDIMENT_BOM)
    forecast = spark.createDataFrame([("latte hot", D(2025, 2, 3), 10.0)], "Item string, Date date, Predicted double")
    assert rows(shop.forecast_to_materials(forecast, menu, condiment), "Raw_Material") == [
        (D(2025, 2, 3), "Milk", 2.0), (D(2025, 2, 3), "Sugar", 20.0)]


@pytest.mark.parametrize("family", ["linear", "additive"])
def test_retrain_records_a_run(spark, tmp_path, family, monkeypatch):
    from demandloom.forecast import families
    monkeypatch.setattr(families, "FAMILIES", families.FAMILIES + ("linear",))
    rng = np.random.default_rng(6)
    demand = series_frame(spark, {n: rng.integers(1, 30, 120) for n in ("a", "b", "c")}, start=D(2023, 1, 2))
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    empty = lambda s: spark.createDataFrame([], s)
    before = spark.createDataFrame(
        [(4, family, dt.datetime(2024, 1, 1), True), (5, "forest", dt.datetime(2024, 1, 1), True)],
        "id int, model_type string, trained_at timestamp, is_active boolean")
    tables = RunTables(before, empty(schemas.RUN_CLASS_METRICS), empty(schemas.RUN_TOP_ITEMS), empty(schemas.FORECASTS))
    after = shop.retrain(demand, items, tables, family, weeks=4, max_items=2, settings=PooledSettings(rounds=3))
    assert rows(after.runs.select("id", "is_active"), "id") == [(4, False), (5, True), (6, True)]
    assert after.forecasts.where("model_run_id = 6").count() == 8
    written = shop.write_run_tables(after, str(tmp_path))
    stored = spark.read.parquet(written["forecasts"])
    assert stored.where("model_run_id = 6 and quantity_predicted >= 0").count() == 8
    assert shop.read_run_tables(spark, str(tmp_path / "nothing")).runs.isEmpty()
    assert registry.latest_active_run(spark.read.parquet(written["runs"])).first()["id"] == 6
    with pytest.raises(ValueError):
        shop.retrain(demand, items, tables, "unknown")
    # The usual cycle: read what is stored, retrain, save to the same place.
    read = shop.read_run_tables(spark, str(tmp_path))
    assert rows(registry.items_of_run(read, family), "item") == [("a",), ("b",)]
    again = shop.retrain(demand, items, read, family, weeks=2, max_items=2, settings=PooledSettings(rounds=3))
    for _ in range(2):  # a save that is repeated changes nothing
        shop.write_run_tables(again, str(tmp_path))
        read = shop.read_run_tables(spark, str(tmp_path))
        assert rows(read.runs.select("id", "is_active"), "id") == [(4, False), (5, True), (6, False), (7, True)]
        assert rows(read.forecasts.groupBy("model_run_id").count(), "model_run_id") == [(6, 8), (7, 4)]
        assert {r["model_run_id"] for r in read.class_metrics.collect()} == {6, 7}
        assert rows(read.item_models, "model_run_id", "item_name") == [(6, "a"), (6, "b"), (7, "a"), (7, "b")]
    # A registry stored before runs had such rows is read without them.
    shop.write_run_tables(replace(again, item_models=None), str(tmp_path / "older"))
    assert shop.read_run_tables(spark, str(tmp_path / "older")).item_models.isEmpty()


def test_summary_files(spark, tmp_path):
    held = spark.createDataFrame([("a", 5.0, 4.0), ("b", 2.0, 2.0)], "Item string, Quantity_Sold double, Predicted double")
    written = shop.write_forecast_summary(shop.evaluate(held), str(tmp_path))
    assert spark.read.json(written["global_metrics"]).first()["mae"] == 0.5
    assert spark.read.json(written["abc_classifications"]).count() == 2


@pytest.mark.parametrize("frequency,step", [("weekly", 7), ("daily", 1)])
def test_exploratory_frames(spark, frequency, step):
    rng = np.random.default_rng(2)
    data = materialise(series_frame(spark, {"Black Ice": rng.integers(0, 20, 60), "x": rng.integers(0, 20, 50)}, start=D(2025, 3, 3), step=step))
    frame = features.exploratory_features(data, frequency)
    assert frame.count() == 110
    lows = frame.agg(*[F.min(F.col(c).isNull()).alias(c) for c in frame.columns]).first()
    assert not any(lows)
    loose = features.exploratory_features(data, frequency, clip=False)
    assert loose.agg(F.max("Quantity_Sold")).first()[0] >= frame.agg(F.max("Quantity_Sold")).first()[0]

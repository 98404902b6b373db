"""Readers and writers, and the plans behind the joins."""

import datetime as dt
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from demandloom import schemas
from demandloom.operators import aggregates, dimensions
from demandloom.plans import views
from demandloom.sources import adapters, files
from helpers import D, rows


def test_csv_round_trip(spark, tmp_path):
    data = spark.createDataFrame([(D(2025, 1, 1), "a", 2.0)], schemas.FORECAST_FILE)
    files.write_table(data, "forecasts", str(tmp_path), "csv")
    assert rows(files.read_table(spark, "forecasts", str(tmp_path), "csv")) == [(D(2025, 1, 1), "a", 2.0)]
    files.write_table(data, "forecasts", str(tmp_path))
    assert rows(files.read_table(spark, "forecasts", str(tmp_path))) == [(D(2025, 1, 1), "a", 2.0)]


def test_headers_are_stripped_and_alternatives_found(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(" Date_Only , Item ,Quantity\n2025-01-06,Espresso,5\n")
    raw = files.read_csv(spark, str(path))
    assert raw.columns == ["Date_Only", "Item", "Quantity"]
    assert rows(files.read_item_demand(raw)) == [(D(2025, 1, 6), "Espresso", 5.0)]
    other = raw.withColumnsRenamed({"Date_Only": "Date", "Quantity": "Quantity_Sold"})
    assert rows(files.read_item_demand(other)) == [(D(2025, 1, 6), "Espresso", 5.0)]
    with pytest.raises(ValueError):
        files.pick_column(raw, "nothing")


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "forecasts").mkdir()
    (tmp_path / "forecasts" / "a.csv").write_text("Item, Date ,Quantity_Sold\na,2025-01-01,2.5\nb,never,x\n")
    assert rows(files.read_table(spark, "forecasts", str(tmp_path), "csv"), "Item") == [(D(2025, 1, 1), "a", 2.5), (None, "b", None)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_named_column_that_is_absent_is_an_error(spark, tmp_path, fmt):
    spark.createDataFrame([("a", 1.0)], "Item string, Quantity_Sold double").write.option("header", True).format(fmt).save(f"{tmp_path}/forecasts")
    with pytest.raises(ValueError, match="Date"):
        files.read_table(spark, "forecasts", str(tmp_path), fmt)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_every_stage_table_round_trips(spark, sf, tmp_path, fmt):
    lines = adapters.sale_lines(spark, sf).limit(200)
    daily = aggregates.daily_item_sales(lines, adapters.item_categories(spark, sf))
    receipts = spark.createDataFrame([(dt.datetime(2025, 1, 1, 9), "r", *["x"] * 6, *[1.5] * 7, *["y"] * 8)], schemas.RECEIPTS)
    tables = {
        "merged_sales": receipts, "cleaned_sales": receipts, "daily_item_sales": daily,
        "daily_category_sales": aggregates.daily_category_sales(daily), "daily_total_sales": aggregates.daily_total_sales(daily),
        "forecasts": spark.createDataFrame([(D(2025, 1, 1), "a", 2.0)], schemas.FORECAST_FILE),
        "menu_bom": spark.createDataFrame([("T", "i", "b", "1", "gr")], schemas.MENU_BOM),
        "condiment_bom": spark.createDataFrame([("c", "1", "gr", "s", "2", "ml")], schemas.CONDIMENT_BOM)}
    assert tables.keys() == files.STAGE_TABLES.keys()
    for name, df in tables.items():
        assert set(df.columns) == set(files.STAGE_TABLES[name].names)
        held = df.select(*files.STAGE_TABLES[name].names).collect()
        files.write_table(spark.createDataFrame(held, files.STAGE_TABLES[name]), name, str(tmp_path), fmt)
        found = files.read_table(spark, name, str(tmp_path), fmt)
        assert found.columns == files.STAGE_TABLES[name].names
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, held), key=repr)


def test_reload_may_read_the_folder_it_replaces(spark, tmp_path):
    files.reload_all({"items": spark.createDataFrame([(1,)], "id int")}, str(tmp_path), ["items"])
    more = spark.read.parquet(f"{tmp_path}/items").unionByName(spark.createDataFrame([(2,)], "id int"))
    files.reload_all({"items": more}, str(tmp_path), ["items"])
    assert rows(spark.read.parquet(f"{tmp_path}/items"), "id") == [(1,), (2,)]


PROGRAM = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from demandloom.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
for name in ("pacf", "forecast_arima"):
    print("ROWS", name, entry.queries()[name](spark, {sf!r}).count())
"""


def test_workers_find_the_package_from_another_folder(sf, tmp_path):
    root = str(Path(files.__file__).resolve().parents[2])
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=root, sf=sf)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.count("ROWS") == 2, done.stderr[-2000:]


def test_reload_replaces(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "id int")
    two = spark.createDataFrame([(2,)], "id int")
    for frame in (one, two):
        files.reload_all({"categories": frame, "items": frame}, str(tmp_path), ["categories", "items"])
    assert rows(spark.read.parquet(f"{tmp_path}/items")) == [(2,)]


def test_metadata_json(spark, sf, tmp_path):
    lines = adapters.sale_lines(spark, sf)
    daily = views.daily_items(spark, sf)
    meta = aggregates.transformation_metadata(lines, daily, adapters.item_categories(spark, sf))
    files.write_table(meta, "metadata", str(tmp_path), "json")
    text = next((tmp_path / "metadata").glob("*.json")).read_text()
    found = json.loads(text)
    assert found["original_transactions"] == lines.count() and len(found["top_items"]) == 20
    assert found["categories"] == sorted(found["categories"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()





def test_scan_reads_only_what_is_used(spark, sf):
    demand = views.demand(spark, sf).where(F.col("Date") >= F.lit(D(1998, 1, 1)))
    text = plan(demand.groupBy("Item").agg(F.sum("Quantity_Sold")))
    schemas_read = [line.split("ReadSchema: ")[1] for line in text.splitlines() if "ReadSchema" in line]
    assert sorted(schemas_read) == sorted([
        "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>",
        "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", "struct<p_partkey:bigint,p_name:string>"])
    assert "o_orderdate" in text.split("PushedFilters")[2] or "GreaterThanOrEqual" in text


def test_catalogue_meets_summed_lines(spark, sf):
    text = plan(views.daily_quantity(spark, sf))
    # Reading the plan upwards from the scans: the sum by part comes before the catalogue joins.
    assert text.index("Join [l_partkey") < text.index("keys=[Date#", text.index("Join [l_partkey"))


def test_no_party_join_unless_asked(spark, sf):
    assert "supplier" not in plan(adapters.sale_lines(spark, sf))
    assert "supplier" in plan(adapters.sale_lines(spark, sf, party=True))


def test_hot_key_join_is_split(spark):
    """A third of the lines on one key: the shuffled join splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(300_000).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("key"), F.col("id").alias("v")).repartition(8)
        dims = spark.range(1000).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"))
        joined = lines.join(dims, "key").groupBy("name").agg(F.count("*").alias("n"))
        found = {r["name"]: r["n"] for r in joined.collect()}
        assert found["n7"] == 100_000 + sum(1 for i in range(300_000) if i % 3 and i % 1000 == 7)
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_item_facts_drop_unknown_items(spark):
    sales = spark.createDataFrame([(D(2025, 1, 1), " a ", 2.0), (D(2025, 1, 1), "a", 3.0), (D(2025, 1, 1), "zz", 1.0)],
                                  "Date date, Item string, Quantity_Sold double")
    items = spark.createDataFrame([(4, "a")], "id long, name string")
    assert rows(dimensions.item_facts(sales, items)) == [(D(2025, 1, 1), 4, 5.0)]

"""The shop's recurring jobs, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandloom import schemas
from demandloom.forecast import families
from demandloom.forecast.pooled import PooledSettings
from demandloom.functions.dates import TradingCalendar
from demandloom.operators import aggregates, bom, cleaning, features, metrics, registry, series
from demandloom.operators.registry import RunTables
from demandloom.session import materialise
from demandloom.sources.files import is_there, read_version, write_table, write_version


def clean_receipts(spark: SparkSession, paths: Sequence[str], menu: DataFrame, remove_discontinued: bool = True) -> DataFrame:
    """Receipt files to cleaned sale lines."""
    merged = cleaning.merge_receipt_files(spark, paths)
    if merged is None:
        raise ValueError("at least two receipt files are needed")
    return cleaning.keep_active(cleaning.standardise_names(merged, menu), menu, remove_discontinued)


def write_daily_tables(lines: DataFrame, menu: DataFrame, folder: str, fmt: str = "parquet") -> dict[str, str]:
    """The three daily aggregates and their metadata; the item table is computed once."""
    categories = aggregates.last_category(menu)
    daily = materialise(aggregates.daily_item_sales(lines, categories))
    tables = {
        "daily_item_sales": daily,
        "daily_category_sales": aggregates.daily_category_sales(daily),
        "daily_total_sales": aggregates.daily_total_sales(daily),
    }
    written = {name: write_table(df, name, folder, fmt) for name, df in tables.items()}
    meta = aggregates.transformation_metadata(lines, daily, categories)
    return written | {"transformation_metadata": write_table(meta, "transformation_metadata", folder, "json")}


def forecast_to_materials(forecast: DataFrame, menu_bom: DataFrame, condiment_bom: DataFrame) -> DataFrame:
    """Raw-material needs of a forecast (Date, Item, Predicted)."""
    return bom.material_requirements(forecast, menu_bom, condiment_bom, quantity="Predicted")


def evaluate(predictions: DataFrame) -> dict[str, DataFrame]:
    """Global, class and item accuracy and the ABC classes of hold-out forecasts."""
    held = materialise(predictions)
    classified = materialise(metrics.classify_abc(held))
    return {
        "global_metrics": metrics.forecast_metrics(held, materialised=True),
        "class_metrics": metrics.class_metrics(held, classified),
        "top_items": metrics.top_class_a(held, classified),
        "abc_classifications": classified,
    }


def write_forecast_summary(analysis: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {name: write_table(df, name, folder, "json") for name, df in analysis.items()}


def retrain(
    demand: DataFrame,
    items: DataFrame,
    tables: RunTables,
    family: str = "boosted",
    weeks: int = 12,
    max_items: int | None = None,
    calendar: TradingCalendar = TradingCalendar(),
    settings: PooledSettings = PooledSettings(),
) -> RunTables:
    """Train on all weeks, evaluate on the hold-out, forecast, and record the run.

    ``demand`` is Date, Item, Quantity_Sold; ``items`` has id and name. Earlier runs of the family
    go inactive.
    """
    if family not in families.FAMILIES:
        raise ValueError(f"family must be one of {families.FAMILIES}")
    weekly = series.item_series(demand)
    if max_items:
        weekly = series.first_items(materialise(weekly), max_items)
    weekly = materialise(weekly)
    codes = materialise(series.item_codes(weekly))
    frame = weekly if family not in families.POOLED else materialise(
        features.create_features(weekly, "weekly", calendar, codes))
    analysis = evaluate(families.train_and_predict(frame, family, settings=settings))
    bundle = families.train(frame, family, settings=settings)
    forecast = families.generate_forecast(weekly, bundle, weeks, calendar, codes)

    run_id = registry.next_run_id(tables.runs).first()["id"]
    own = bundle.item_models.agg(F.count(F.lit(1)).cast("int")).scalar()
    extent = weekly.agg(
        F.count(F.lit(1)).alias("n_records"), F.min("Date").alias("date_range_start"), F.max("Date").alias("date_range_end"))
    extent_row = extent.select(F.struct("*")).scalar()
    run = analysis["global_metrics"].drop("n_items").withColumn("_e", extent_row).select("*", "_e.*").select(
        F.lit(run_id).alias("id"), F.lit(family).alias("model_type"), F.current_timestamp().alias("trained_at"),
        own.alias("n_item_models"), "n_records", "date_range_start", "date_range_end", "r2", "wmape", "mae",
        "volume_accuracy", "median_period_accuracy", "periods_within_20pct", "periods_within_50pct",
        F.to_json(F.array(*map(F.lit, bundle.columns))).alias("features"),
        F.to_json(F.struct(F.lit(max_items).cast("int").alias("max_items"))).alias("params"),
        F.lit(True).alias("is_active"),
    )
    classes = analysis["class_metrics"].select(
        F.lit(run_id).alias("model_run_id"), F.col("Class").alias("abc_class"), "n_items", "wmape",
        "volume_accuracy", "median_period_accuracy")
    top = analysis["top_items"].select(
        F.lit(run_id).alias("model_run_id"), F.col("Item").alias("item_name"),
        F.col("Quantity_Sold").alias("quantity_sold"), F.col("Predicted").alias("predicted"), "accuracy_pct")
    stored = registry.resolve_items(forecast, items, run_id)
    # The run's own rows are computed once, whatever is read from the registry later.
    own_items = bundle.item_models.select(F.lit(run_id).alias("model_run_id"), F.col("Item").alias("item_name"))
    return registry.record_run(
        tables, materialise(run), materialise(classes), materialise(top), materialise(stored), materialise(own_items))


def write_run_tables(tables: RunTables, folder: str) -> dict[str, str]:
    """Store the runs that ``folder`` doesn't have yet, and the registry's new state.

    The tables may be read from the same folder. Children are laid out by run and only new runs are
    written, so a stored forecast is never rewritten and a repeated save replaces its own rows. The
    registry is a new version that readers see once it is complete, after its children.
    """
    spark = tables.runs.sparkSession
    stored = read_version(spark, f"{folder}/runs")
    ids = tables.runs.select(F.col("id").alias("model_run_id"))
    # Written out first: the stored registry is replaced below.
    fresh = materialise(ids if stored is None else ids.join(stored.select(F.col("id").alias("model_run_id")), "model_run_id", "left_anti"))
    written = {}
    for name, child in tables.children().items():
        written[name] = f"{folder}/{name}"
        child.join(fresh, "model_run_id", "left_semi").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("model_run_id").parquet(written[name])
    return written | {"runs": write_version(tables.runs, f"{folder}/runs")}


def read_run_tables(spark: SparkSession, folder: str) -> RunTables:
    """The stored registry; empty tables where nothing is stored."""
    def child(name: str, schema: StructType) -> DataFrame:
        if runs is None or not is_there(spark, f"{folder}/{name}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.names)

    runs = read_version(spark, f"{folder}/runs")
    return RunTables(
        runs=spark.createDataFrame([], schemas.MODEL_RUNS) if runs is None else runs,
        class_metrics=child("class_metrics", schemas.RUN_CLASS_METRICS), top_items=child("top_items", schemas.RUN_TOP_ITEMS),
        forecasts=child("forecasts", schemas.FORECASTS), item_models=child("item_models", schemas.RUN_ITEM_MODELS))

"""Frames several queries start from, built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators import aggregates, features, series
from demandloom.operators.ranking import row_numbers
from demandloom.operators.registry import RunTables
from demandloom.session import materialise
from demandloom.sources import adapters


def demand(spark: SparkSession, folder: str) -> DataFrame:
    """Date, Item, Quantity_Sold of the lines, to be summed."""
    return adapters.demand_lines(spark, folder).select(
        "Date", "Item", F.col("Quantity").alias("Quantity_Sold")
    )


def lazy_series(spark: SparkSession, folder: str, frequency: str = "weekly") -> DataFrame:
    """The zero-filled item series, planned only, for queries that read it once."""
    return series.item_series(demand(spark, folder), frequency)


def item_series(spark: SparkSession, folder: str, frequency: str = "weekly") -> DataFrame:
    """The zero-filled item series, computed once: one row per item and period."""
    return materialise(lazy_series(spark, folder, frequency))


def daily_items(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.daily_item_sales(
        adapters.demand_lines(spark, folder), adapters.item_categories(spark, folder)
    )


def daily_quantity(spark: SparkSession, folder: str) -> DataFrame:
    return demand(spark, folder).groupBy("Date", "Item").agg(F.sum("Quantity_Sold").alias("Quantity_Sold"))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals, computed once: one row per calendar day."""
    return materialise(aggregates.daily_totals(demand(spark, folder), "Quantity_Sold"))


def category_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Category ids in name order; one category is left unregistered."""
    names = (
        adapters.table(spark, folder, "part").select(F.col("p_type").alias("name"))
        .where(F.col("name") != "PROMO").distinct()
    )
    return row_numbers(names, [F.col("name")], "id").select("id", "name")


def item_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Item ids in name order with their category id; ``old …`` items are unregistered."""
    named = adapters.item_categories(spark, folder).where(~F.col("Item").startswith("old "))
    categories = category_dim(spark, folder).select(
        F.col("id").alias("category_id"), F.col("name").alias("Category")
    )
    return row_numbers(named, [F.col("Item")], "id").join(categories, "Category", "left").select(
        "id", F.col("Item").alias("name"), "category_id"
    )


def held_out_naive(spark: SparkSession, folder: str) -> DataFrame:
    """The hold-out weeks with the four-week mean as forecast."""
    weekly = item_series(spark, folder)
    frame = weekly.withColumns(features.rolling_columns(4, 12))
    factors = features.weekday_factors(series.holdout_split(weekly).where(~F.col("is_test")))
    scored = series.holdout_split(frame).where(F.col("is_test") & F.col("Roll_Mean_4").isNotNull()).select(
        "Item", "Date", "Quantity_Sold", F.col("Roll_Mean_4").alias("Raw_Pred")
    )
    return materialise(
        features.apply_weekday_factors(scored, factors).select("Item", "Date", "Quantity_Sold", "Predicted")
    )


def mean_forecast(history: DataFrame, frequency: str = "daily", weeks: int = 12) -> DataFrame:
    """The fallback forecast: mean demand of all series times the weekday factor."""
    periods = weeks * 7 if frequency == "daily" else weeks
    grid = series.future_grid(history, periods, frequency)
    mean = history.agg(F.avg("Quantity_Sold")).scalar()
    return features.apply_weekday_factors(
        grid.withColumn("Raw_Pred", mean), features.weekday_factors(history)
    )


def run_tables(spark: SparkSession, folder: str) -> RunTables:
    return RunTables(**adapters.run_tables(spark, folder))

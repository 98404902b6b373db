"""Daily sales aggregates, period summaries and profiles.

Facts are aggregated before any dimension is joined; Spark's partial aggregation collapses a hot
item or day inside each map task, so at most one row per key and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions import text
from demandloom.functions.dates import OUTSIDE_TRADING, temporal_columns, trading_period
from demandloom.operators.cleaning import consolidate, exclude_items


def last_category(menu: DataFrame, line: str | None = None) -> DataFrame:
    """Item to category; where an item is listed twice the last line wins."""
    order = F.col(line) if line else F.trim("Tipe")
    return (
        menu.where(F.col("Item").isNotNull() & F.col("Tipe").isNotNull())
        .groupBy(F.trim("Item").alias("Item"))
        .agg(F.max_by(F.trim("Tipe"), order).alias("Category"))
    )


def add_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    return df.join(categories, "Item", "left").withColumn(
        "Category", F.coalesce("Category", F.lit("Unknown"))
    )


def daily_item_sales(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Positive quantities by date and item with category and date parts."""
    summed = (
        lines.where(F.col("Quantity") > 0)
        .groupBy(F.col("Date").cast("date").alias("Date_Only"), F.trim("Item").alias("Item"))
        .agg(
            F.sum("Quantity").alias("Quantity"),
            F.sum("Net sales").alias("Net sales"),
            F.sum("Gross sales").alias("Gross sales"),
        )
    )
    return add_category(summed, categories).withColumns(temporal_columns(F.col("Date_Only")))


_SUMS = ("Quantity", "Net sales", "Gross sales")


def daily_category_sales(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy("Date_Only", "Category")
        .agg(*[F.sum(c).alias(c) for c in _SUMS], F.count("Item").alias("UniqueItemCount"))
        .withColumns(temporal_columns(F.col("Date_Only")))
    )


def daily_total_sales(daily: DataFrame) -> DataFrame:
    """Totals by date. Categories fold first, so the distinct count needs no second shuffle of items."""
    return (
        daily_category_sales(daily)
        .groupBy("Date_Only")
        .agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            F.sum("UniqueItemCount").alias("UniqueItemCount"),
            F.count("Category").alias("UniqueCategoryCount"),
        )
        .withColumns(temporal_columns(F.col("Date_Only")))
    )


def daily_item_quantity(lines: DataFrame) -> DataFrame:
    """Cleaned quantities by date and item."""
    return (
        exclude_items(consolidate(lines))
        .groupBy(F.col("Date").cast("date").alias("Date"), "Item")
        .agg(F.sum("Quantity").alias("Quantity_Sold"))
    )


def period_sales(lines: DataFrame) -> DataFrame:
    """Quantities by date, item and trading period; sales outside trading hours are dropped."""
    return (
        exclude_items(consolidate(lines))
        .withColumn("Time_Period", trading_period(F.hour("Date")))
        .where(F.col("Time_Period") != OUTSIDE_TRADING)
        .groupBy(F.col("Date").cast("date").alias("Date"), "Item", "Time_Period")
        .agg(F.sum("Quantity").alias("Quantity_Sold"))
    )


def period_summary(by_period: DataFrame) -> DataFrame:
    return by_period.groupBy("Time_Period").agg(
        F.sum("Quantity_Sold").alias("Total_Quantity_Sold"),
        F.count_distinct("Date").alias("Unique_Dates"),
        F.count_distinct("Item").alias("Unique_Items"),
    )


def daily_totals(lines: DataFrame, quantity: str = "Quantity") -> DataFrame:
    """One row per calendar day."""
    return lines.groupBy("Date").agg(F.sum(quantity).alias("Quantity_Sold"))


def top_items(sales: DataFrame, n: int = 20, quantity: str = "Quantity") -> DataFrame:
    """The ``n`` items sold most, 1 to 100; ties by name."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    return (
        sales.groupBy("Item")
        .agg(F.sum(quantity).alias("total_quantity"))
        .orderBy(F.desc("total_quantity"), "Item")
        .limit(n)
    )


def transformation_metadata(lines: DataFrame, daily: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: counts, date range, categories and the top-20 items as a map."""
    raw = lines.agg(
        F.count(F.lit(1)).alias("original_transactions"),
        F.count_distinct("Item").alias("unique_items"),
    )
    span = daily.agg(
        F.min("Date_Only").alias("date_range_start"),
        F.max("Date_Only").alias("date_range_end"),
        F.count(F.lit(1)).alias("daily_records_created"),
    ).withColumn("total_days", F.date_diff("date_range_end", "date_range_start") + 1)
    listed = categories.select("Category").distinct().agg(
        F.sort_array(F.collect_list("Category")).alias("categories")
    )
    top = top_items(daily).agg(
        F.map_from_entries(F.collect_list(F.struct("Item", "total_quantity"))).alias("top_items")
    )
    # One-row frames side by side.
    return raw.select(
        "*",
        *[span.select(c).scalar().alias(c) for c in span.columns],
        listed.scalar().alias("categories"),
        top.scalar().alias("top_items"),
    )


def data_profile(daily: DataFrame) -> DataFrame:
    """Rows, NULL counts, date range, items, and the distribution of daily totals.

    The quantiles are over one row per calendar day, so a single buffer holds them.
    """
    columns = ("Date", "Item", "Quantity_Sold")
    rows = daily.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c.lower()}") for c in columns],
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.count_distinct("Item").alias("unique_items"),
        F.sum("Quantity_Sold").alias("total_quantity"),
    )
    totals = daily_totals(daily, "Quantity_Sold")
    described = totals.agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("Quantity_Sold").alias("mean"),
        F.stddev_samp("Quantity_Sold").alias("std"),
        F.min("Quantity_Sold").alias("min"),
        F.percentile("Quantity_Sold", F.lit(0.25)).alias("q25"),
        F.percentile("Quantity_Sold", F.lit(0.5)).alias("q50"),
        F.percentile("Quantity_Sold", F.lit(0.75)).alias("q75"),
        F.max("Quantity_Sold").alias("max"),
    )
    stats = described.select(F.struct("*").alias("s")).scalar()
    return rows.withColumn("_s", stats).select(
        "*", *[F.col(f"_s.{c}").alias(c) for c in described.columns]
    ).drop("_s")


def seasonality_profile(totals: DataFrame) -> DataFrame:
    """Mean daily total by weekday and by month, in calendar order."""
    by_day = totals.groupBy(F.weekday("Date").alias("position"), F.date_format("Date", "EEEE").alias("label")).agg(
        F.avg("Quantity_Sold").alias("mean_quantity")
    ).withColumn("kind", F.lit("weekday"))
    by_month = totals.groupBy(F.month("Date").alias("position")).agg(
        F.avg("Quantity_Sold").alias("mean_quantity")
    ).withColumns({"kind": F.lit("month"), "label": F.col("position").cast("string")})
    return by_day.unionByName(by_month)


def with_name_filter(df: DataFrame, column: str, fragment: str | None) -> DataFrame:
    """Case-insensitive contains; no fragment keeps all."""
    if not fragment:
        return df
    return df.where(F.contains(F.lower(F.col(column)), F.lit(fragment.lower())))


def excluded_report(lines: DataFrame, prefix: str, fragment: str) -> DataFrame:
    """Items and lines left after the prefix and fragment exclusions."""
    return exclude_items(lines, prefix, fragment).groupBy("Item").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Quantity").alias("quantity")
    )


def name_keys(lines: DataFrame) -> DataFrame:
    return lines.select(text.name_key(F.col("Item")).alias("key")).distinct()

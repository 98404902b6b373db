"""Filtered, ordered, paged reads of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.aggregates import with_name_filter

MAX_PAGE_SIZE = 1000


def page_of(df: DataFrame, order: Sequence[Column | str], page: int = 1, size: int = 100) -> DataFrame:
    """One page in a total order. Near pages are a top-k; far ones are cut from a distributed sort."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1 and size is 1 to {MAX_PAGE_SIZE}")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def between(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Inclusive date range; an open end keeps all. Dates are compared as dates."""
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def daily_sales(
    facts: DataFrame, items: DataFrame, item: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """date, item, quantity_sold through the item dimension; filters reach both scans."""
    named = items.select(F.col("id").alias("item_id"), F.col("name").alias("item"))
    if item:
        named = named.where(F.col("item") == item)
    return between(facts, start, end).join(named, "item_id").select("date", "item", "quantity_sold")


def daily_sales_page(facts, items, item=None, start=None, end=None, page=1, size=100) -> DataFrame:
    return page_of(daily_sales(facts, items, item, start, end), ["date", "item"], page, size)


def row_count(df: DataFrame) -> DataFrame:
    """Total behind a page."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def category_page(df: DataFrame, category=None, start=None, end=None, page=1, size=100) -> DataFrame:
    kept = between(df, start, end)
    if category:
        kept = kept.where(F.col("category") == category)
    return page_of(kept, ["date", "category"], page, size)


def total_page(df: DataFrame, start=None, end=None, page=1, size=100) -> DataFrame:
    return page_of(between(df, start, end), ["date"], page, size)


def materials(df: DataFrame, material=None, start=None, end=None, exact: bool = False) -> DataFrame:
    """Requirements by material fragment (or exact name) and date range."""
    kept = between(df, start, end)
    if exact and material:
        return kept.where(F.col("raw_material") == material)
    return with_name_filter(kept, "raw_material", material)


def materials_page(df, material=None, start=None, end=None, page=1, size=100) -> DataFrame:
    return page_of(materials(df, material, start, end), ["date", "raw_material"], page, size)


def forecasts(df: DataFrame, item=None, start=None, end=None) -> DataFrame:
    """Stored forecast rows; the filters push down to the table that holds them."""
    kept = between(df, start, end)
    return kept.where(F.col("item") == item) if item else kept


def forecast_page(df, item=None, start=None, end=None, page=1, size=100) -> DataFrame:
    return page_of(forecasts(df, item, start, end), ["date", "item"], page, size)


def forecast_totals(df: DataFrame, quantity: str = "quantity_predicted") -> DataFrame:
    return df.groupBy("date").agg(F.sum(quantity).alias("total"))


def items_with_category(items: DataFrame, categories: DataFrame) -> DataFrame:
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return items.join(cats, "category_id", "left").select(F.col("name").alias("item"), "category").orderBy("item")


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def history_for_items(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Rows of the listed items; an empty list means every item."""
    return df.where(F.col("Item").isin(*names)) if names else df

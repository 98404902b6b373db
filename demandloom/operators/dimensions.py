"""Insert-if-absent loads of dimensions and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.numeric import safe_float
from demandloom.operators.ranking import row_numbers


def new_names(existing: DataFrame, incoming: DataFrame, name: str = "name", extra: Sequence[str] = ()) -> DataFrame:
    """The new names with the ids that follow, in name order, to be appended to ``existing`` (id, name, …)."""
    fresh = (
        incoming.where(F.col(name).isNotNull())
        .groupBy(F.trim(name).alias(name))
        .agg(*[F.min(c).alias(c) for c in extra], F.count(F.lit(1)).alias("_n"))
        .drop("_n")
        .join(existing.select(name), name, "left_anti")
    )
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return row_numbers(fresh, [F.col(name)], "_n").select(
        (highest + F.col("_n")).cast("long").alias("id"), name, *extra
    )


def absent_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The incoming rows whose key is new, to be appended. ``incoming`` is unique on the key."""
    return incoming.join(existing.select(*key), list(key), "left_anti").select(*existing.columns)


def item_facts(sales: DataFrame, items: DataFrame, quantity: str = "Quantity_Sold") -> DataFrame:
    """date, item_id, quantity_sold; rows whose item is not in the dimension are dropped."""
    ids = items.select(F.col("id").alias("item_id"), F.col("name").alias("Item"))
    return (
        sales.groupBy(F.col("Date").cast("date").alias("date"), F.trim("Item").alias("Item"))
        .agg(F.sum(quantity).alias("quantity_sold"))
        .join(ids, "Item")
        .select("date", "item_id", "quantity_sold")
    )


def category_facts(daily: DataFrame, categories: DataFrame) -> DataFrame:
    """date, category_id and measures of the daily category table; unknown categories are dropped."""
    ids = categories.select(F.col("id").alias("category_id"), F.col("name").alias("Category"))
    return daily.join(ids, "Category").select(F.col("Date_Only").alias("date"), "category_id", *_measures())


def total_facts(daily: DataFrame) -> DataFrame:
    """date and measures of the daily total table."""
    return daily.select(F.col("Date_Only").alias("date"), *_measures())


def _measures() -> list[Column]:
    return [
        F.col("Quantity").alias("quantity"), F.col("Net sales").alias("net_sales"), F.col("Gross sales").alias("gross_sales"),
        F.col("UniqueItemCount").alias("unique_items")]


def resolve_bom(menu_bom: DataFrame, categories: DataFrame, items: DataFrame) -> DataFrame:
    """Recipe lines with a numeric quantity, and category and item ids where the names are known."""
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    dims = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"))
    return (
        menu_bom.select(
            F.trim("Tipe").alias("category_name"), F.trim("Item").alias("item_name"),
            F.trim("Bahan").alias("ingredient"), safe_float(F.col("Qty")).alias("quantity"),
            F.trim("Unit").alias("unit"),
        )
        .where(F.col("quantity").isNotNull())
        .join(cats, "category_name", "left")
        .join(dims, "item_name", "left")
    )


def resolve_condiments(condiment_bom: DataFrame) -> DataFrame:
    """Condiment lines with a numeric amount, trimmed."""
    return condiment_bom.select(
        F.trim("Condiment").alias("condiment"),
        safe_float(F.col("Condiment_Qty")).alias("condiment_qty"),
        F.trim("Condiment_Unit").alias("condiment_unit"),
        F.trim("Sub_Ingredient").alias("sub_ingredient"),
        safe_float(F.col("Qty_per_condiment_unit")).alias("qty_per_unit"),
        F.trim("Sub_Unit").alias("sub_unit"),
    ).where(F.col("qty_per_unit").isNotNull())

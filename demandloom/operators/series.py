"""Item series: one row per item and period, gaps filled with zero.

After the aggregation an item has at most one row per period of its life, so windows and groups by
item are bounded by the calendar however hot the item is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.dates import week_label
from demandloom.operators.ranking import row_numbers, running_total
from demandloom.session import materialise

STEP_DAYS = {"weekly": 7, "daily": 1}


def step_days(frequency: str) -> int:
    if frequency not in STEP_DAYS:
        raise ValueError(f"frequency must be one of {sorted(STEP_DAYS)}")
    return STEP_DAYS[frequency]


def by_item(*order: str) -> Window:
    return Window.partitionBy("Item").orderBy(*(order or ("Date",)))


def item_series(demand: DataFrame, frequency: str = "weekly", exclude_prefix: str | None = "add") -> DataFrame:
    """Demand (Date, Item, Quantity_Sold) resampled per item, from its first to its last period.

    Each row reaches up to the next one, so gaps fill in place without joining a date grid.
    """
    days = step_days(frequency)
    if exclude_prefix is not None:
        demand = demand.where(~F.lower(F.trim("Item")).startswith(exclude_prefix))
    day = F.col("Date").cast("date")
    label = week_label(day) if frequency == "weekly" else day
    summed = demand.groupBy("Item", label.alias("Date")).agg(
        F.coalesce(F.sum("Quantity_Sold"), F.lit(0.0)).alias("Quantity_Sold")
    )
    following = F.lead("Date").over(by_item())
    until = F.coalesce(F.date_sub(following, days), F.col("Date"))
    step = F.expr(f"interval {days} days")
    return (
        summed.withColumn("_until", until)
        .withColumn("_period", F.explode(F.sequence("Date", "_until", step)))
        .select(
            "Item",
            F.col("_period").alias("Date"),
            F.when(F.col("_period") == F.col("Date"), F.col("Quantity_Sold")).otherwise(0.0).alias("Quantity_Sold"),
        )
    )


def future_dates(series: DataFrame, periods: int, frequency: str = "weekly") -> DataFrame:
    """The ``periods`` dates that follow the last date of the whole history; none without history.

    Weekly dates are the Mondays after the last date.
    """
    days = step_days(frequency)
    first = F.date_add("_last", days)
    if frequency == "weekly":
        first = week_label(first)
    dates = F.sequence(first, F.date_add(first, days * (periods - 1)), F.expr(f"interval {days} days"))
    return series.agg(F.max("Date").alias("_last")).select(F.explode(dates).alias("Date"))


def future_grid(series: DataFrame, periods: int, frequency: str = "weekly") -> DataFrame:
    """Every item with the ``periods`` dates that follow the last date of the whole history.

    Weekly dates are the Mondays after the last date.
    """
    days = step_days(frequency)
    last = series.agg(F.max("Date")).scalar()
    first = F.date_add(last, days)
    if frequency == "weekly":
        first = week_label(first)
    dates = F.sequence(first, F.date_add(first, days * (periods - 1)), F.expr(f"interval {days} days"))
    return (
        series.select("Item").distinct()
        .select("Item", F.explode(dates).alias("Date"))
        .withColumn("Quantity_Sold", F.lit(0.0))
    )


def item_codes(series: DataFrame) -> DataFrame:
    """Zero-based position of each item in name order."""
    items = series.select("Item").distinct()
    return row_numbers(items, [F.col("Item")], "_n").select(
        "Item", (F.col("_n") - 1).cast("int").alias("Item_Code")
    )


def holdout_split(df: DataFrame, periods: int = 12) -> DataFrame:
    """Mark ``is_test`` from ``periods`` weeks before the last date, that date included."""
    last = df.agg(F.max("Date")).scalar()
    return df.withColumn("is_test", F.col("Date") >= F.date_sub(last, periods * 7))


def train_val_split(df: DataFrame, ratio: float = 0.15) -> DataFrame:
    """Positional split of the frame in (Item, Date) order: the last ``ratio`` of rows validate.

    Positions come from per-item counts and a running total over items, so no task sees the frame.
    """
    counts = materialise(df.groupBy("Item").agg(F.count(F.lit(1)).alias("_rows")))
    upto = running_total(counts, [F.col("Item")], F.col("_rows"), "_upto")
    starts = upto.select("Item", (F.col("_upto") - F.col("_rows")).alias("_start"))
    total = counts.agg(F.sum("_rows")).scalar()
    placed = df.join(starts, "Item").withColumn(
        "row", F.col("_start") + F.row_number().over(by_item())
    )
    size = F.greatest(F.lit(1).cast("long"), F.floor(total * F.lit(ratio)).cast("long"))
    return placed.withColumn("is_val", F.col("row") > total - size).drop("_start")


def first_items(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` items by name."""
    names = df.select("Item").distinct().orderBy("Item").limit(n)
    return df.join(names, "Item", "left_semi")


def model_eligibility(series: DataFrame, minimum: int) -> DataFrame:
    """Rows per item and whether the item gets its own model."""
    return series.groupBy("Item").agg(F.count(F.lit(1)).alias("records")).withColumn(
        "own_model", F.col("records") >= minimum
    )

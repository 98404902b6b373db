"""The exploratory frame for cross-validation: what is fitted on values is fitted inside each fold's past.

Lags and windows only look back. The surges around the event and the bounds that columns are clipped to depend on values
of other rows, so they are computed from the rows before each fold's test window, for all folds at once; a change of a
test value changes no training row of its fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.forecast.families import cv_rows
from demandloom.functions.dates import TradingCalendar
from demandloom.operators import features as feats
from demandloom.operators.ranking import exact_quantiles
from demandloom.session import materialise

KEYS = ("fold", "is_test", "Item", "Date")


def _past_mean(inside: Column) -> Column:
    """Mean of the fold's past quantities of an item where ``inside`` holds."""
    item = Window.partitionBy("fold", "Item")
    return F.avg(F.when(~F.col("is_test") & inside, F.col("Quantity_Sold"))).over(item)


def unclipped(series: DataFrame, folds: Sequence[tuple[str, str]], calendar: TradingCalendar, surge_item: str,
              frequency: str = "weekly") -> DataFrame:
    """The exploratory features of every fold's rows, with surges of the fold's past and differences as known before."""
    frame = materialise(feats.known_before(feats.exploratory_features(series, frequency, calendar, surge_item, clip=False)))
    rows = cv_rows(frame, folds)
    event = F.lit(calendar.event_date).cast("date")
    means = rows.withColumns({"_pre": _past_mean(F.col("Date") < event), "_post": _past_mean(F.col("Date") >= event)})
    pre, post = F.col("_pre"), F.col("_post")
    surges = {"Item_Surge": feats.faded(surge_item, calendar.event_date, pre, post), "Rebrand_Surge": feats.surge_of(pre, post, 2.0)}
    return feats.zero_missing(means.withColumns(surges).drop("_pre", "_post"))


def bounds(rows: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """fold, name, lo, hi: exact quantiles of each column over each fold's past, all in one ranking."""
    past = rows.where(~F.col("is_test"))
    cells = past.select("fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("cell"))
    return exact_quantiles(cells.select("fold", "cell.name", "cell.value"), "value", {"lo": low, "hi": high}, ["fold", "name"])


def fold_frames(series: DataFrame, folds: Sequence[tuple[str, str]], calendar: TradingCalendar = TradingCalendar(),
                surge_item: str = "Black Ice", frequency: str = "weekly") -> DataFrame:
    """fold, is_test, Item, Date, Quantity_Sold and the features, clipped to the bounds of the fold's past.

    Test quantities stay as they are: forecasts are held against what was sold.
    """
    rows = materialise(unclipped(series, folds, calendar, surge_item, frequency))
    columns = [c for c in rows.columns if c not in (*KEYS, "Item_Code")]
    packed = bounds(rows, columns).groupBy("fold").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("lo", "hi").alias("b")))).alias("_bounds"))

    def clipped(c: str) -> Column:
        bound, value = F.col("_bounds")[c], F.col(c).cast("double")
        held = F.greatest(bound.lo, F.least(bound.hi, value))
        return F.when(F.col("is_test"), value).otherwise(held) if c == "Quantity_Sold" else held

    return rows.join(packed, "fold").withColumns({c: clipped(c) for c in columns}).select(*KEYS, "Item_Code", *columns)

"""Forecasts that feed on themselves: each period's features see the periods forecast before it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.forecast import perseries, pooled
from demandloom.forecast.state import SeriesState, StatePlan, is_window
from demandloom.functions.dates import TradingCalendar
from demandloom.operators import features as feats
from demandloom.operators.series import future_dates, item_codes, step_days
from demandloom.session import materialise, spread

# Fewest days for a daily model of an item's own.
MIN_ROWS = 30
# Of the features of the exploratory daily frame, those that no forecast uses.
UNUSED = ("Item", "Date", "Quantity_Sold")


def walk(series: DataFrame, facts: DataFrame, periods: int, frequency: str, columns: Sequence[str], calendar: TradingCalendar,
         plan: StatePlan, responder: Callable, fill_idle: bool = False) -> DataFrame:
    """Item, Date, Raw_Pred, Predicted for the ``periods`` after the last date of the whole history.

    ``facts`` has a row per item with Item_Code and whatever else ``responder(facts, values)`` wants; that returns, per
    item, a function from a period's one-row features and date to the raw and the final forecast. An item's history is
    its rows in the order of their dates, filled with zeros up to the common end with ``fill_idle``.
    """
    fixed = [c for c in columns if c != "Item_Code" and not is_window(c)]
    # One row per period of the horizon.
    known = feats.add_calendar(future_dates(series, periods, frequency), calendar, extended=True, history=series).select(
        "Date", *fixed).orderBy("Date").toPandas()
    dates = [d if isinstance(d, dt.date) else d.date() for d in known["Date"]]
    table = known[fixed].to_numpy(float)
    names = list(columns)
    at_fixed, at_window = ([names.index(c) for c in group] for group in (fixed, plan.names))
    at_code = names.index("Item_Code") if "Item_Code" in names else None
    days = step_days(frequency)

    def forecast(mine: pd.DataFrame, fact: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(fact):
            return pd.DataFrame(columns=["Item", "Date", "Raw_Pred", "Predicted"])
        mine = mine.sort_values("Date")
        item, values = mine["Item"].iloc[0], mine["Quantity_Sold"].to_numpy(float)
        row = fact.iloc[0].to_dict()
        state = SeriesState(plan, item, mine["Date"], values)
        if fill_idle:
            day = mine["Date"].iloc[-1] + dt.timedelta(days=days)
            while day < dates[0]:
                state.push(day, 0.0)
                day += dt.timedelta(days=days)
        respond = responder(row, values)
        x, found = np.zeros((1, len(names))), []
        for day, line in zip(dates, table):
            x[0, at_fixed], x[0, at_window] = line, state.features(day)
            if at_code is not None:
                x[0, at_code] = row["Item_Code"]
            raw, value = respond(x, day)
            state.push(day, value)
            found.append((item, day, raw, value))
        return pd.DataFrame(found, columns=["Item", "Date", "Raw_Pred", "Predicted"])

    # Under a name of its own, as facts may come from the same series.
    history = spread(series.select(F.col("Item").alias("Item"), "Date", "Quantity_Sold"), "Item").groupBy("Item")
    return history.cogroup(spread(facts, "Item").groupBy("Item")).applyInPandas(
        forecast, "Item string, Date date, Raw_Pred double, Predicted double")


def daily_frame(series: DataFrame, calendar: TradingCalendar, surge_item: str) -> DataFrame:
    """The exploratory daily features, with differences as known before the day."""
    frame = feats.exploratory_features(series, "daily", calendar, surge_item, clip=False)
    return feats.known_before(frame)


def recursive_forecast(series: DataFrame, days: int = 90, calendar: TradingCalendar = TradingCalendar(),
                       surge_item: str = "Black Ice") -> DataFrame:
    """Item, Date, Predicted for the ``days`` after the last date of the whole history.

    Items with enough history have a regression of their own on all features of the exploratory daily frame, the others
    use the pooled one. Forecasts stay between zero and twice the item's maximum and are whole units.
    """
    frame = materialise(daily_frame(series, calendar, surge_item))
    columns = [c for c in frame.columns if c not in UNUSED]
    model = pooled.as_numbers(pooled.fit_pooled(frame, columns, "linear", pooled.PooledSettings()), columns)
    own = perseries.fit_item_regressions(frame, columns, MIN_ROWS)
    facts = item_codes(series).join(own, "Item", "left")

    def responder(facts: dict, values: np.ndarray):
        cap = 2.0 * values.max()

        def respond(x: np.ndarray, day) -> tuple[float, float]:
            if facts["coefficients"] is None:
                raw = float(model.predict(x)[0])
            else:
                raw = float(facts["intercept"] + x[0] @ np.asarray(facts["coefficients"], float))
            return raw, float(np.round(min(max(0.0, raw), cap)))

        return respond

    plan = StatePlan.of(columns, calendar.event_date, surge_item=surge_item)
    return walk(series, facts, days, "daily", columns, calendar, plan, responder, fill_idle=True).select("Item", "Date", "Predicted")

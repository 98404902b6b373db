"""Model features over item series.

All window columns share one partitioning (Item) and one order (Date): one exchange and one sort for
the whole frame. A window never holds more than the periods of one item.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.dates import (
    DEFAULT_EVENT_DATE, TradingCalendar, calendar_columns, extended_calendar_columns,
)
from demandloom.functions.numeric import half_even, safe_ratio
from demandloom.operators.ranking import exact_quantiles
from demandloom.operators.series import by_item, future_grid, item_codes
from demandloom.session import materialise, spread


@dataclass(frozen=True)
class WindowPlan:
    """Lag steps and window lengths, in periods."""

    lags: tuple[int, ...]
    short: int
    long: int


PLANS = {
    "weekly": WindowPlan(lags=(1, 2, 4), short=4, long=12),
    "daily": WindowPlan(lags=(1, 7, 14), short=7, long=28),
}

CALENDAR_FEATURES = (
    "Month", "Week", "Year", "DOY", "DOW", "Sin_Week", "Cos_Week", "Weeks_Since_Start",
    "Is_Payday_Week", "Is_Weekend_Before_Payday", "Is_Holiday", "Is_Ramadan",
    "Is_Post_Rebranding", "Weeks_Since_Rebrand",
)


def feature_columns(frequency: str = "weekly") -> list[str]:
    plan = PLANS[frequency]
    s, l = plan.short, plan.long
    return [
        "Item_Code", *CALENDAR_FEATURES, "Post_Rebrand_Surge_Ratio", "Recent_vs_Old_Trend",
        *[f"Lag_{n}" for n in plan.lags], f"Roll_Mean_{s}", f"Roll_Mean_{l}", f"Roll_Std_{s}",
        f"Roll_Q95_{s}", f"EWMA_{s}", f"EWMA_{l}", "Diff_1", "Accel_2",
    ]


# Features that look at the period's own quantity.
LEAKING = ("Diff_1", "Diff_4", "Diff_7", "Accel_2")


def known_before(frame: DataFrame) -> DataFrame:
    """Differences as known before the period: the raw ones contain the target itself."""
    return frame.withColumns({
        name: F.coalesce(F.lag(name, 1).over(by_item()), F.lit(0.0)) for name in LEAKING if name in frame.columns
    })


def _q() -> Column:
    return F.col("Quantity_Sold")


def _before(periods: int, gap: int = 0) -> Window:
    """The ``periods`` rows that end ``gap`` rows before the previous row."""
    return by_item().rowsBetween(-(periods + gap), -(1 + gap))


def lag_columns(lags: Sequence[int]) -> dict[str, Column]:
    return {f"Lag_{n}": F.lag("Quantity_Sold", n).over(by_item()) for n in lags}


def rolling_columns(short: int, long: int) -> dict[str, Column]:
    return {
        f"Roll_Mean_{short}": F.avg("Quantity_Sold").over(_before(short)),
        f"Roll_Mean_{long}": F.avg("Quantity_Sold").over(_before(long)),
        f"Roll_Std_{short}": F.stddev_samp("Quantity_Sold").over(_before(short)),
        f"Roll_Q95_{short}": F.percentile("Quantity_Sold", F.lit(0.95)).over(_before(short)),
    }


def add_ewma(df: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Exponentially weighted means (recursive form) of the earlier rows, one column per span.

    The recursion unrolls to decaying weights. Rows fall in blocks so long that what came before the
    previous block weighs less than double precision can show: a running sum inside the block plus
    the decayed value at the end of the previous block is the whole mean, in constant work per row.
    """
    q = F.col("Quantity_Sold")
    decay = {name: 1 - 2.0 / (span + 1) for name, span in spans.items()}
    block = max(math.ceil(math.log(1e-17) / math.log(d)) for d in decay.values())
    if min(decay.values()) ** -block > 1e200:
        raise ValueError("spans too far apart for one block length")
    place = F.row_number().over(by_item()) - 1
    placed = df.withColumn("_i", place).withColumns({
        "_b": F.floor(F.col("_i") / block), "_j": F.col("_i") % block,
    })
    inside = Window.partitionBy("Item", "_b").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    local, means, shifted = {}, {}, {}
    for name, d in decay.items():
        fade = F.pow(F.lit(d), F.col("_j"))
        # The first row of a series enters with full weight.
        entry = F.when(F.col("_i") == 0, q / F.lit(1 - d)).otherwise(q)
        local[f"_l_{name}"] = F.lit(1 - d) * fade * F.sum(entry / fade).over(inside)
        ended = F.last(
            F.when(F.col("_j") == block - 1, F.col(f"_l_{name}")), ignorenulls=True
        ).over(by_item().rowsBetween(Window.unboundedPreceding, -1))
        means[f"_e_{name}"] = F.col(f"_l_{name}") + F.coalesce(F.lit(d) * fade * ended, F.lit(0.0))
        shifted[name] = F.lag(f"_e_{name}", 1).over(by_item())
    return (
        placed.withColumns(local).withColumns(means).withColumns(shifted)
        .drop("_i", "_b", "_j", *local, *means)
    )


def difference_columns(steps: Sequence[int] = (1,)) -> dict[str, Column]:
    found = {f"Diff_{n}": _q() - F.lag("Quantity_Sold", n).over(by_item()) for n in steps}
    found["Accel_2"] = (
        _q() - 2 * F.lag("Quantity_Sold", 1).over(by_item()) + F.lag("Quantity_Sold", 2).over(by_item())
    )
    return found


def trend_ratio(short: int, long: int, cap: float = 10.0) -> Column:
    """Recent mean over older mean plus one; NULL until both windows are full."""

    def full_mean(periods: int, gap: int) -> Column:
        frame = _before(periods, gap)
        return F.when(F.count("Quantity_Sold").over(frame) == periods, F.avg("Quantity_Sold").over(frame))

    ratio = full_mean(short, 0) / (full_mean(long, short) + 1)
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(float(cap))))


def event_means(event_date: str) -> tuple[Column, Column]:
    """Mean quantity of an item before and from the event day."""
    item = Window.partitionBy("Item")
    event = F.lit(event_date).cast("date")
    return (
        F.avg(F.when(F.col("Date") < event, _q())).over(item),
        F.avg(F.when(F.col("Date") >= event, _q())).over(item),
    )


def surge_of(pre: Column, post: Column, cap: float | None = None) -> Column:
    """Post-event mean over pre-event mean plus one; 1 without post data, NULL without pre data."""
    ratio = post / (pre + 1)
    if cap is not None:
        ratio = F.when(ratio.isNotNull(), F.least(ratio, F.lit(float(cap))))
    return F.when(post.isNull(), F.lit(1.0)).otherwise(ratio)


def surge_ratio(event_date: str, cap: float | None = None) -> Column:
    """``surge_of`` an item's own means."""
    return surge_of(*event_means(event_date), cap)


def faded(item: str, event_date: str, pre: Column, post: Column, cap: float = 3.0, horizon_days: int = 140, floor: float = 0.3) -> Column:
    """Surge of one named item, fading linearly to a floor; 1 for every other row."""
    event = F.lit(event_date).cast("date")
    fade = F.greatest(
        F.lit(float(floor)), 1 - F.date_diff("Date", event) / F.lit(float(horizon_days))
    )
    active = (
        (F.col("Item") == item) & (F.col("Date") >= event) & pre.isNotNull() & post.isNotNull()
    )
    return F.when(active, F.least(post / (pre + 1), F.lit(float(cap))) * fade).otherwise(F.lit(1.0))


def decayed_surge(item: str, event_date: str) -> Column:
    """``faded`` by an item's own means."""
    return faded(item, event_date, *event_means(event_date))


def event_surge(series: DataFrame, event_date: str = DEFAULT_EVENT_DATE, cap: float | None = None) -> DataFrame:
    """Pre and post means and the surge ratio, one row per item."""
    event = F.lit(event_date).cast("date")
    means = series.groupBy("Item").agg(
        F.avg(F.when(F.col("Date") < event, _q())).alias("pre_mean"),
        F.avg(F.when(F.col("Date") >= event, _q())).alias("post_mean"),
    )
    ratio = F.col("post_mean") / (F.col("pre_mean") + 1)
    if cap is not None:
        ratio = F.when(ratio.isNotNull(), F.least(ratio, F.lit(float(cap))))
    return means.withColumn("surge", F.when(F.col("post_mean").isNull(), F.lit(1.0)).otherwise(ratio))


def add_calendar(
    df: DataFrame, calendar: TradingCalendar, extended: bool = False, history: DataFrame | None = None
) -> DataFrame:
    """Calendar features; weeks and days count from the first date of ``history`` (or of ``df``)."""
    origin = (df if history is None else history).agg(F.min("Date")).scalar()
    with_origin = df.withColumn("_origin", origin)
    day, start = F.col("Date"), F.col("_origin")
    columns = calendar_columns(day, start, calendar)
    if extended:
        columns |= extended_calendar_columns(day, start, calendar)
    return with_origin.withColumns(columns).drop("_origin")


def zero_missing(df: DataFrame) -> DataFrame:
    """NULL in any number column becomes 0; ratios never produce infinities."""
    return df.na.fill(0)


def create_features(
    series: DataFrame,
    frequency: str = "weekly",
    calendar: TradingCalendar = TradingCalendar(),
    codes: DataFrame | None = None,
) -> DataFrame:
    """The 28 model features beside Item, Date and Quantity_Sold.

    ``series`` is read three times (origin, codes, windows): pass a materialised one. ``codes`` from
    the full history keeps an item's code stable on a subset.
    """
    plan = PLANS[frequency]
    s, l = plan.short, plan.long
    # One layout by item serves the code join and every window.
    coded = spread(series, "Item").join(item_codes(series) if codes is None else codes, "Item")
    windows = {
        **lag_columns(plan.lags),
        **rolling_columns(s, l),
        **difference_columns(),
        "Recent_vs_Old_Trend": trend_ratio(s, l),
        "Post_Rebrand_Surge_Ratio": surge_ratio(calendar.event_date),
    }
    averaged = add_ewma(coded, {f"EWMA_{n}": n for n in (s, l)})
    full = add_calendar(averaged, calendar, history=series).withColumns(windows)
    return zero_missing(full).select("Item", "Date", "Quantity_Sold", *feature_columns(frequency))


def exploratory_columns(frequency: str, calendar: TradingCalendar, surge_item: str) -> dict[str, Column]:
    """Window columns of the exploratory models, before filling and clipping."""
    q = "Quantity_Sold"
    if frequency == "weekly":
        return {
            **lag_columns((1, 2, 4, 8)),
            **{f"Roll_Mean_{n}": F.avg(q).over(_before(n)) for n in (4, 8, 12)},
            **{f"Roll_Std_{n}": F.stddev_samp(q).over(_before(n)) for n in (4, 8)},
            "Diff_1": _q() - F.lag(q, 1).over(by_item()),
            "Diff_4": _q() - F.lag(q, 4).over(by_item()),
            "Recent_vs_Old_Trend": trend_ratio(4, 8, cap=5.0),
            "Item_Surge": decayed_surge(surge_item, calendar.event_date),
            "Rebrand_Surge": surge_ratio(calendar.event_date, cap=2.0),
        }
    return {
        **lag_columns((1, 7, 14)),
        **{f"Roll_Mean_{n}": F.avg(q).over(_before(n)) for n in (7, 14)},
        "Roll_Std_7": F.stddev_samp(q).over(_before(7)),
        "Diff_1": _q() - F.lag(q, 1).over(by_item()),
        "Diff_7": _q() - F.lag(q, 7).over(by_item()),
        "Item_Surge": decayed_surge(surge_item, calendar.event_date),
        "Rebrand_Surge": surge_ratio(calendar.event_date, cap=2.0),
    }


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clip every column to its own quantiles, exact at any row count.

    The columns are unpivoted and their values counted, so the quantiles come from distributed
    ranks; the bounds are one row per column and come back as a one-row map.
    """
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
        ])).alias("cell")
    ).select("cell.name", "cell.value")
    bounds = exact_quantiles(long, "value", {"lo": low, "hi": high}, ["name"])
    packed = bounds.agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("lo", "hi").alias("b"))))
    ).scalar()
    clipped = {}
    for c in columns:
        bound = F.col("_bounds")[c]
        value = F.col(c).cast("double")
        clipped[c] = F.when(value.isNotNull(), F.greatest(bound.lo, F.least(bound.hi, value)))
    return df.withColumn("_bounds", packed).withColumns(clipped).drop("_bounds")


def exploratory_features(
    series: DataFrame,
    frequency: str = "weekly",
    calendar: TradingCalendar = TradingCalendar(),
    surge_item: str = "Black Ice",
    clip: bool = True,
) -> DataFrame:
    """Extended calendar, wider windows and surges; NULLs to 0 and, by default, winsorised."""
    spans = {"EWMA_4": 4, "EWMA_8": 8} if frequency == "weekly" else {"EWMA_7": 7}
    coded = add_ewma(spread(series, "Item").join(item_codes(series), "Item"), spans)
    full = zero_missing(
        add_calendar(coded, calendar, extended=True, history=series).withColumns(
            exploratory_columns(frequency, calendar, surge_item)
        )
    )
    if not clip:
        return full
    numeric = [c for c in full.columns if c not in ("Item", "Date", "Item_Code")]
    return winsorise(materialise(full), numeric)


def future_features(
    series: DataFrame,
    weeks: int = 12,
    frequency: str = "weekly",
    calendar: TradingCalendar = TradingCalendar(),
    codes: DataFrame | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda frame: frame,
    periods: int | None = None,
) -> DataFrame:
    """Features of the future periods; future quantities are 0 and enter later windows as such.

    ``finish`` works on history and future together, before the future is cut out.
    """
    if periods is None:
        periods = weeks * 7 if frequency == "daily" else weeks
    grid = future_grid(series, periods, frequency)
    last = series.agg(F.max("Date")).scalar()
    everything = series.unionByName(grid)
    codes = item_codes(series) if codes is None else codes
    featured = finish(create_features(everything, frequency, calendar, codes))
    return featured.where(F.col("Date") > last)


def weekday_factors(series: DataFrame) -> DataFrame:
    """Item, DOW, dow_factor: mean of the weekday over the item's mean; 1 when undefined."""
    sums = series.groupBy("Item", F.weekday("Date").alias("DOW")).agg(
        F.sum("Quantity_Sold").alias("s"), F.count("Quantity_Sold").alias("n")
    )
    item = Window.partitionBy("Item")
    overall = F.sum("s").over(item) / F.sum("n").over(item)
    return sums.withColumn("_all", overall).select(
        "Item", "DOW", F.coalesce(safe_ratio(F.col("s") / F.col("n"), F.col("_all")), F.lit(1.0)).alias("dow_factor")
    )


def weekday_factor_matrix(factors: DataFrame) -> DataFrame:
    """One row per item and one column per weekday; absent weekdays count as 1."""
    wide = factors.groupBy("Item").pivot("DOW", list(range(7))).agg(F.first("dow_factor")).na.fill(1.0)
    return wide.select("Item", *[F.col(str(d)).alias(f"dow_{d}") for d in range(7)])


def apply_weekday_factors(scored: DataFrame, factors: DataFrame) -> DataFrame:
    """``Raw_Pred`` to ``Predicted``: not negative, times the weekday factor, whole units half-even."""
    return (
        scored.withColumn("Raw_Pred", F.greatest(F.lit(0.0), F.col("Raw_Pred")))
        .withColumn("DOW", F.weekday("Date"))
        .join(factors, ["Item", "DOW"], "left")
        .withColumn("dow_factor", F.coalesce("dow_factor", F.lit(1.0)))
        .withColumn(
            "Predicted", F.greatest(F.lit(0.0), half_even(F.col("Raw_Pred") * F.col("dow_factor")))
        )
    )

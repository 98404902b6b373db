"""Resampling, windows and features; pandas checks the window arithmetic."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.functions.dates import TradingCalendar
from demandloom.operators import features, series
from helpers import D, rows, series_frame

CALENDAR = TradingCalendar()


def test_daily_zero_fill_is_per_item(spark):
    demand = spark.createDataFrame(
        [(D(2025, 1, 1), "a", 2.0), (D(2025, 1, 4), "a", 1.0), (D(2025, 1, 4), "a", 3.0), (D(2025, 1, 2), "b", 5.0),
         (D(2025, 1, 2), "Add x", 5.0)], "Date date, Item string, Quantity_Sold double")
    assert rows(series.item_series(demand, "daily"), "Item", "Date") == [
        ("a", D(2025, 1, 1), 2.0), ("a", D(2025, 1, 2), 0.0), ("a", D(2025, 1, 3), 0.0), ("a", D(2025, 1, 4), 4.0),
        ("b", D(2025, 1, 2), 5.0)]


def test_weekly_matches_pandas(spark):
    rng = np.random.default_rng(1)
    days = pd.to_datetime("2024-12-20") + pd.to_timedelta(rng.integers(0, 200, 80), unit="D")
    frame = pd.DataFrame({"Date": days, "Item": rng.choice(["x", "y"], 80), "Quantity_Sold": rng.integers(0, 9, 80).astype(float)})
    expected = frame.set_index("Date").groupby("Item").resample("W-MON")["Quantity_Sold"].sum().reset_index()
    demand = spark.createDataFrame(frame.assign(Date=frame["Date"].dt.date))
    got = rows(series.item_series(demand, "weekly"), "Item", "Date")
    assert got == [(r.Item, r.Date.date(), r.Quantity_Sold) for r in expected.itertuples()]


def test_rolling_literals(spark):
    data = series_frame(spark, {"a": [3, 1, 4, 1, 5, 9]})
    got = data.withColumns(features.rolling_columns(4, 12)).orderBy("Date").collect()
    assert [r["Roll_Q95_4"] for r in got] == [None, 3.0, pytest.approx(2.9), pytest.approx(3.9), pytest.approx(3.85), pytest.approx(4.85)]
    assert [r["Roll_Std_4"] for r in got] == [None, None] + [pytest.approx(v, abs=1e-6) for v in (1.414214, 1.527525, 1.5, 2.061553)]
    ew = features.add_ewma(data, {"e": 4}).orderBy("Date").collect()
    assert [r["e"] for r in ew] == [None, 3.0] + [pytest.approx(v) for v in (2.2, 2.92, 2.152, 3.2912)]


@pytest.mark.parametrize("spans,length", [((4, 12), 900), ((7, 28), 1300)])
def test_ewma_over_many_blocks(spark, spans, length):
    rng = np.random.default_rng(5)
    values = {"a": rng.integers(0, 50, length), "b": np.where(rng.random(length) < 0.02, 1000, 0), "c": [7]}
    found = features.add_ewma(series_frame(spark, values, step=1), {f"e{s}": s for s in spans}).orderBy("Item", "Date").toPandas()
    for item, quantities in values.items():
        mine = found[found["Item"] == item]
        for span in spans:
            expected = pd.Series(quantities, dtype=float).shift(1).ewm(span=span, adjust=False).mean()
            np.testing.assert_allclose(mine[f"e{span}"].astype(float), expected, rtol=1e-9, atol=1e-9)


def pandas_features(frame, plan, calendar):
    """Window features of one item."""
    q, s, l = frame["q"], plan.short, plan.long
    shifted = q.shift(1)
    out = pd.DataFrame({f"Lag_{n}": q.shift(n) for n in plan.lags})
    out[f"Roll_Mean_{s}"] = shifted.rolling(s, min_periods=1).mean()
    out[f"Roll_Mean_{l}"] = shifted.rolling(l, min_periods=1).mean()
    out[f"Roll_Std_{s}"] = shifted.rolling(s, min_periods=1).std()
    out[f"Roll_Q95_{s}"] = shifted.rolling(s, min_periods=1).quantile(0.95)
    out[f"EWMA_{s}"] = shifted.ewm(span=s, adjust=False).mean()
    out[f"EWMA_{l}"] = shifted.ewm(span=l, adjust=False).mean()
    out["Diff_1"], out["Accel_2"] = q.diff(), q.diff().diff()
    out["Recent_vs_Old_Trend"] = (shifted.rolling(s).mean() / (q.shift(s + 1).rolling(l).mean() + 1)).clip(0, 10)
    event = pd.Timestamp(calendar.event_date)
    post, pre = q[frame["d"] >= event].mean(), q[frame["d"] < event].mean()
    out["Post_Rebrand_Surge_Ratio"] = post / (pre + 1) if pd.notna(post) else 1.0
    return out.fillna(0.0)


@pytest.mark.parametrize("frequency,step", [("weekly", 7), ("daily", 1)])
def test_features_match_pandas(spark, frequency, step):
    rng = np.random.default_rng(9)
    values = {"b": rng.integers(0, 30, 60), "a": rng.integers(0, 5, 45), "c": [4]}
    data = series_frame(spark, values, start=D(2025, 3, 3), step=step)
    got = features.create_features(data, frequency, CALENDAR).orderBy("Item", "Date").toPandas()
    assert list(got.columns[3:]) == features.feature_columns(frequency) and len(features.feature_columns(frequency)) == 28
    assert not got.isna().any().any()
    assert got.groupby("Item")["Item_Code"].first().to_dict() == {"a": 0, "b": 1, "c": 2}
    for item, quantities in values.items():
        mine = got[got["Item"] == item].reset_index(drop=True)
        frame = pd.DataFrame({"d": pd.to_datetime(mine["Date"]), "q": np.asarray(quantities, dtype=float)})
        expected = pandas_features(frame, features.PLANS[frequency], CALENDAR)
        for name in expected:
            np.testing.assert_allclose(mine[name].astype(float), expected[name], atol=1e-9, err_msg=f"{item} {name}")


def test_holdout_has_thirteen_weeks(spark):
    data = series_frame(spark, {"a": range(30)})
    marked = series.holdout_split(data)
    assert marked.where("is_test").count() == 13
    daily = series_frame(spark, {"a": range(120)}, step=1)
    assert series.holdout_split(daily).where("is_test").count() == 85


def test_positional_split_takes_last_names(spark):
    data = series_frame(spark, {"a": range(40), "b": range(40), "z": range(20)})
    got = series.train_val_split(data)
    assert rows(got.groupBy("Item").agg(F.sum(F.col("is_val").cast("int"))), "Item") == [("a", 0), ("b", 0), ("z", 15)]
    assert [r["row"] for r in got.orderBy("Item", "Date").collect()] == list(range(1, 101))


def test_future_grid(spark):
    weekly = series_frame(spark, {"a": range(3), "b": range(2)})
    grid = rows(series.future_grid(weekly, 2), "Item", "Date")
    assert grid == [(i, d, 0.0) for i in "ab" for d in (D(2025, 1, 27), D(2025, 2, 3))]
    daily = series_frame(spark, {"a": [1]}, start=D(2025, 1, 1), step=1)
    assert [r[1] for r in rows(series.future_grid(daily, 3, "daily"), "Date")] == [D(2025, 1, d) for d in (2, 3, 4)]


def test_future_features_see_zero_quantities(spark):
    data = series_frame(spark, {"a": [10] * 20})
    got = features.future_features(data, 3, "weekly", CALENDAR).orderBy("Date").collect()
    assert [r["Lag_1"] for r in got] == [10.0, 0.0, 0.0]


def test_codes_of_the_full_history_hold_on_a_subset(spark):
    data = series_frame(spark, {"a": [1] * 5, "m": [1] * 5, "z": [1] * 5})
    codes = series.item_codes(data)
    part = features.create_features(data.where("Item = 'z'"), "weekly", CALENDAR, codes)
    assert part.select("Item_Code").first()[0] == 2


def test_weekly_factors_are_one(spark):
    data = series_frame(spark, {"a": [1, 5, 9], "b": [0, 0]})
    assert {r[2] for r in rows(features.weekday_factors(data))} == {1.0}


def test_daily_factors_and_adjustment(spark):
    data = series_frame(spark, {"a": [2, 4, 6, 4, 4, 4, 4]}, start=D(2025, 1, 6), step=1)
    matrix = features.weekday_factor_matrix(features.weekday_factors(data)).first()
    assert [round(v, 6) for v in matrix[1:]] == [0.5, 1.0, 1.5, 1.0, 1.0, 1.0, 1.0]
    scored = spark.createDataFrame(
        [("a", D(2025, 1, 13), 5.0), ("a", D(2025, 1, 14), -2.0), ("new", D(2025, 1, 15), 2.5)], "Item string, Date date, Raw_Pred double")
    got = rows(features.apply_weekday_factors(scored, features.weekday_factors(data)).select("Date", "Predicted"), "Date")
    assert [r[1] for r in got] == [2.0, 0.0, 2.0]


def test_event_surge_cases(spark):
    start = D(2025, 4, 28)
    data = series_frame(spark, {"both": [4, 10], "pre": [4], "late": [0]}, start=start).unionByName(
        series_frame(spark, {"post": [6]}, start=D(2025, 5, 5)))
    got = {r["Item"]: r["surge"] for r in features.event_surge(data).collect()}
    assert got == {"both": 2.0, "pre": 1.0, "late": 1.0, "post": None}


def test_winsorise(spark):
    values = list(map(float, range(101)))
    data = spark.createDataFrame([(v, -v) for v in values], "x double, y double")
    got = features.winsorise(data, ["x", "y"]).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(got) == (5.0, 95.0, -95.0, -5.0)


def test_first_items_and_eligibility(spark):
    data = series_frame(spark, {"c": range(5), "a": range(2), "b": range(3)})
    assert {r["Item"] for r in series.first_items(data, 2).collect()} == {"a", "b"}
    assert rows(series.model_eligibility(data, 3), "Item") == [("a", 2, False), ("b", 3, True), ("c", 5, True)]


def test_bad_frequency(spark):
    with pytest.raises(ValueError):
        series.item_series(series_frame(spark, {"a": [1]}).select("Date", "Item", "Quantity_Sold"), "hourly")


def test_windows_share_one_exchange(spark):
    """The code join and all window columns need one shuffle of the series."""
    data = series_frame(spark, {"a": range(30), "b": range(30)})
    codes = spark.createDataFrame([("a", 0), ("b", 1)], "Item string, Item_Code int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = features.create_features(data, "weekly", CALENDAR, codes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for the series, one for the code table.
    assert plan.count("Exchange hashpartitioning") == 2, plan

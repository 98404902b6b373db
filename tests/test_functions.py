"""Scalar functions on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.functions import dates, numeric, text
from helpers import D, rows


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def mapped(spark, values, expression, kind="string"):
    df = column(spark, values, kind).select("i", expression(F.col("v")).alias("out"))
    return [r[1] for r in rows(df, "i")]


def test_week_label_closes_on_monday(spark):
    days = [D(2025, 1, 6), D(2025, 1, 7), D(2025, 1, 12), D(2025, 1, 13)]
    assert mapped(spark, days, dates.week_label, "date") == [
        D(2025, 1, 6), D(2025, 1, 13), D(2025, 1, 13), D(2025, 1, 13)]


def test_receipt_dates_in_format_order(spark):
    texts = ["13/05/25 23.43", "9/25/25 10:07 PM", "09/25/2025 10:07 pm", "2025-09-25 10:07:00", "junk", None,
             " 5/6/25 7:05 ", "01/02/99 08.00"]
    stamp = dt.datetime
    got = mapped(spark, texts, lambda c: dates.parse_receipt_time(c).cast("timestamp_ntz"))
    assert got == [
        stamp(2025, 5, 13, 23, 43), stamp(2025, 9, 25, 22, 7), stamp(2025, 9, 25, 22, 7), stamp(2025, 9, 25, 10, 7),
        None, None, stamp(2025, 6, 5, 7, 5), stamp(1999, 2, 1, 8, 0)]


def test_trading_periods(spark):
    assert mapped(spark, [7, 8, 12, 13, 17, 18, 23], dates.trading_period, "int") == [
        "Other", "08:00-13:00", "08:00-13:00", "13:00-18:00", "13:00-18:00", "18:00-24:00", "18:00-24:00"]


def test_temporal_columns(spark):
    df = column(spark, [D(2024, 2, 29)], "date").select(
        *[c.alias(n) for n, c in dates.temporal_columns(F.col("v")).items()])
    row = df.first().asDict()
    assert row["DayOfWeek"] == 3 and row["DayOfWeekName"] == "Thursday" and row["WeekOfYear"] == 9
    assert row["MonthProgress"] == 1.0 and row["IsWeekend"] == 0 and row["DayOfYear"] == 60


def test_calendar_flags(spark):
    calendar = dates.TradingCalendar()
    days = [D(2024, 1, 1), D(2025, 3, 15), D(2025, 5, 1), D(2025, 5, 30), D(2026, 4, 10), D(2026, 4, 11)]
    columns = dates.calendar_columns(F.col("v"), F.lit(D(2024, 1, 1)), calendar) | {
        "near": dates.extended_calendar_columns(F.col("v"), F.lit(D(2024, 1, 1)), calendar)["Is_Near_Holiday"]}
    got = rows(column(spark, days, "date").select("i", *[columns[c].alias(c) for c in (
        "Is_Holiday", "Is_Ramadan", "Is_Post_Rebranding", "Weeks_Since_Rebrand", "Is_Payday_Week",
        "Is_Weekend_Before_Payday", "Weeks_Since_Start", "near")]), "i")
    assert [r[1:] for r in got] == [
        (1, 0, 0, 0.0, 1, 0, 0, 1), (0, 1, 0, 0.0, 0, 0, 62, 0), (1, 0, 1, 0.0, 1, 0, 69, 1),
        (0, 0, 1, pytest.approx(29 / 7), 1, 1, 73, 1), (0, 1, 1, pytest.approx(344 / 7), 0, 0, 118, 0),
        (0, 0, 1, pytest.approx(345 / 7), 0, 0, 118, 0)]


def test_number_scrub_loses_sign_and_comma(spark):
    assert mapped(spark, ["-5", "1.2.3", "Rp 10.000", "1,5", "abc", None, "5.5"], numeric.scrub_number) == [
        5.0, None, 10.0, 15.0, None, None, 5.5]


def test_decimal_comma_and_safe_float(spark):
    assert mapped(spark, [" 1,5 ", "2.5", "x", None], numeric.decimal_comma) == [1.5, 2.5, None, None]
    assert mapped(spark, ["3", "x", None], lambda c: numeric.safe_float(c, 0.0)) == [3.0, 0.0, 0.0]


def test_half_even(spark):
    assert mapped(spark, [0.5, 1.5, 2.5, -0.4], numeric.half_even, "double") == [0.0, 2.0, 2.0, 0.0]


def test_modifier_suffix(spark):
    df = spark.createDataFrame(
        [(1, "Latte", "Hot"), (2, "Latte Ice", "Hot"), (3, " Mocha ", " Ice "), (4, "Tea", "Large"), (5, "Tea", None)],
        "i int, name string, m string")
    got = rows(df.select("i", text.with_modifier(F.col("name"), F.col("m")).alias("o")), "i")
    assert [r[1] for r in got] == ["Latte Hot", "Latte Ice", "Mocha Ice", "Tea", "Tea"]


def test_names_and_rule_text(spark):
    assert mapped(spark, ["V60 X", "Latte", None], text.collapse_pattern) == ["Filter", "Latte", None]
    names = ["skm", " cleo galon ", "bsj", "BEANS arabika", "cleo's", "3in1 mix", "beans-arabika (dark)", "a--b  c", "crème brûlée"]
    assert mapped(spark, names, text.material_name) == [
        "SKM", "Cleo Galon", "BSJ", *[n.strip().title() for n in names[3:]]]
    assert mapped(spark, ["frozenset({'Es Teh'})", "plain"], text.single_item_of_set_text) == ["Es Teh", "plain"]
    assert mapped(spark, ["{'A', 'b', 'a'}", "", None, "[X]"], text.items_of_rule_text) == [["a", "b"], [], [], ["x"]]
    assert mapped(spark, ['["A", " b ", ""]', "not json", None], text.items_of_json_text) == [["a", "b"], [], []]


def test_product_variant(spark):
    df = spark.createDataFrame([(1, "P", None), (2, "P", "default"), (3, "P", "L")], "i int, p string, v string")
    pick = lambda bare: [r[1] for r in rows(df.select("i", text.product_variant_name(F.col("p"), F.col("v"), bare).alias("o")), "i")]
    assert pick("default") == ["P", "P", "P L"]
    assert pick(None) == ["P", "P default", "P L"]

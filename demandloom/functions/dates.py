"""Date parsing, period labels, date parts and the trading calendar."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Receipt timestamp formats in the order they are tried.
RECEIPT_DATE_FORMATS = (
    "d/M/yy H.m",
    "d/M/yy H:m",
    "M/d/yy h:m a",
    "M/d/yyyy h:m a",
)

# Holidays, fasting ranges and the re-opening day of the default calendar.
DEFAULT_HOLIDAYS = (
    "2024-01-01", "2024-04-10", "2024-04-11", "2024-04-12", "2024-05-01", "2024-05-23",
    "2024-06-01", "2024-06-17", "2024-12-25",
    "2025-01-01", "2025-03-01", "2025-03-30", "2025-03-31", "2025-05-01", "2025-05-12",
    "2025-06-01", "2025-06-07", "2025-12-25",
    "2026-01-01", "2026-02-17", "2026-03-09", "2026-05-01", "2026-05-21", "2026-12-25",
)
DEFAULT_FASTING = (
    ("2024-02-28", "2024-04-10"),
    ("2025-02-28", "2025-04-10"),
    ("2026-02-28", "2026-04-10"),
)
DEFAULT_EVENT_DATE = "2025-05-01"

# Trading periods as (first hour, hour after the last, label).
TRADING_PERIODS = ((8, 13, "08:00-13:00"), (13, 18, "13:00-18:00"), (18, 24, "18:00-24:00"))
OUTSIDE_TRADING = "Other"


@dataclass(frozen=True)
class TradingCalendar:
    """Dates that shape demand; a few dozen constants, folded into the plan as literals."""

    event_date: str = DEFAULT_EVENT_DATE
    holidays: tuple[str, ...] = DEFAULT_HOLIDAYS
    fasting: tuple[tuple[str, str], ...] = DEFAULT_FASTING

    def near_holidays(self, days: int = 3) -> list[dt.date]:
        """Every date within ``days`` of a holiday, so the range test becomes an equality test."""
        found = {
            dt.date.fromisoformat(day) + dt.timedelta(days=shift)
            for day in self.holidays
            for shift in range(-days, days + 1)
        }
        return sorted(found)


def parse_receipt_time(text: Column) -> Column:
    """Try the receipt formats in order, then the general cast; NULL when nothing fits.

    Two-digit years 69 to 99 belong to the 1900s.
    """
    trimmed = F.upper(F.trim(text))
    tries = []
    for fmt in RECEIPT_DATE_FORMATS:
        parsed = F.try_to_timestamp(trimmed, F.lit(fmt))
        if "yyyy" not in fmt:
            century = F.expr("interval 100 years")
            parsed = F.when(F.year(parsed) >= 2069, parsed - century).otherwise(parsed)
        tries.append(parsed)
    return F.coalesce(*tries, F.try_to_timestamp(trimmed))


def week_label(day: Column) -> Column:
    """The Monday that closes the week of ``day``; a Monday closes its own week."""
    return F.date_add(day, F.pmod(F.lit(9) - F.dayofweek(day), F.lit(7)).cast("int"))


def trading_period(hour: Column) -> Column:
    period = F.lit(OUTSIDE_TRADING)
    for first, after, label in reversed(TRADING_PERIODS):
        period = F.when((hour >= first) & (hour < after), F.lit(label)).otherwise(period)
    return period


def temporal_columns(day: Column) -> dict[str, Column]:
    weekday = F.weekday(day)
    return {
        "Year": F.year(day),
        "Month": F.month(day),
        "Day": F.dayofmonth(day),
        "DayOfWeek": weekday,
        "DayOfWeekName": F.date_format(day, "EEEE"),
        "WeekOfYear": F.weekofyear(day),
        "Quarter": F.quarter(day),
        "DayOfYear": F.dayofyear(day),
        "IsWeekend": (weekday >= 5).cast("int"),
        "MonthProgress": F.dayofmonth(day) / F.dayofmonth(F.last_day(day)),
    }


def is_holiday(day: Column, calendar: TradingCalendar) -> Column:
    return day.isin(*[dt.date.fromisoformat(d) for d in calendar.holidays])


def is_fasting(day: Column, calendar: TradingCalendar) -> Column:
    inside = F.lit(False)
    for start, end in calendar.fasting:
        inside = inside | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return inside


def calendar_columns(day: Column, origin: Column, calendar: TradingCalendar) -> dict[str, Column]:
    """Calendar features of one date; ``origin`` is the first date of the whole history."""
    week = F.weekofyear(day)
    month_day = F.dayofmonth(day)
    weekday = F.weekday(day)
    event = F.lit(calendar.event_date).cast("date")
    angle = week * F.lit(2 * math.pi) / F.lit(52.0)
    return {
        "Month": F.month(day),
        "Week": week,
        "Year": F.year(day),
        "DOY": F.dayofyear(day),
        "DOW": weekday,
        "Sin_Week": F.sin(angle),
        "Cos_Week": F.cos(angle),
        "Weeks_Since_Start": F.floor(F.date_diff(day, origin) / 7).cast("int"),
        "Is_Payday_Week": ((month_day <= 7) | (month_day >= 25)).cast("int"),
        "Is_Weekend_Before_Payday": ((weekday >= 4) & (month_day >= 25)).cast("int"),
        "Is_Holiday": is_holiday(day, calendar).cast("int"),
        "Is_Ramadan": is_fasting(day, calendar).cast("int"),
        "Is_Post_Rebranding": (day >= event).cast("int"),
        "Weeks_Since_Rebrand": F.greatest(F.date_diff(day, event) / F.lit(7.0), F.lit(0.0)),
    }


def extended_calendar_columns(day: Column, origin: Column, calendar: TradingCalendar) -> dict[str, Column]:
    """The further calendar features of the exploratory models."""
    month_angle = F.month(day) * F.lit(2 * math.pi) / F.lit(12.0)
    month_day = F.dayofmonth(day)
    weekend = (F.weekday(day) >= 5).cast("int")
    payday = ((month_day <= 7) | (month_day >= 25)).cast("int")
    event = F.lit(calendar.event_date).cast("date")
    return {
        "Quarter": F.quarter(day),
        "Is_Weekend": weekend,
        "Sin_Month": F.sin(month_angle),
        "Cos_Month": F.cos(month_angle),
        "Days_Since_Start": F.date_diff(day, origin),
        "Day_Of_Month": month_day,
        "Is_Payday": payday,
        "Is_Near_Holiday": day.isin(*calendar.near_holidays()).cast("int"),
        "Days_Since_Rebrand": F.greatest(F.date_diff(day, event), F.lit(0)),
        "Payday_Weekend": payday * weekend,
        "Holiday_Weekend": is_holiday(day, calendar).cast("int") * weekend,
    }

"""Queries over item series: resampling, windows, features, weekday factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.numeric import rounded
from demandloom.operators import features, series
from demandloom.plans import views
from demandloom.plans.oracle_views import VIEWS, with_
from demandloom.plans.queries_cleaning import CALENDAR_SQL, EXTENDED_SQL
from demandloom.sources.adapters import STAR_CALENDAR
from demandloom.session import materialise

QUERIES, ORACLES = {}, {}
_W = 'OVER (PARTITION BY Item ORDER BY "Date"{0})'
_WEEKLY = ("sales", "weekly_sums", "weekly")
EVENT = STAR_CALENDAR.event_date


def _over(frame: str = "") -> str:
    return _W.format(f" ROWS BETWEEN {frame}" if frame else "")


def _round_all(df, digits=6):
    """Round every double. Exponential means of whole numbers often end on an exact rounding tie,
    where the last bit of a sum would decide, so they are lifted off the tie first."""

    def column(c):
        return rounded(F.col(c) + 1e-9 if c.startswith("EWMA") else c, digits)

    return df.withColumns({c: column(c) for c, kind in df.dtypes if kind == "double"})


def weekly_item_sales(spark, sf):
    return views.lazy_series(spark, sf)


ORACLES["weekly_item_sales"] = with_(*_WEEKLY, body='SELECT Item, "Date", q AS Quantity_Sold FROM weekly')


def daily_item_series(spark, sf):
    return views.lazy_series(spark, sf, "daily")


ORACLES["daily_item_series"] = with_("sales", "dailyseries", body='SELECT Item, "Date", q AS Quantity_Sold FROM dailyseries')


def weekly_nonzero(spark, sf):
    return views.lazy_series(spark, sf).where(F.col("Quantity_Sold") > 0)


ORACLES["weekly_nonzero"] = with_(*_WEEKLY, body='SELECT Item, "Date", q AS Quantity_Sold FROM weekly WHERE q > 0')


def first_n_items(spark, sf):
    return series.first_items(views.item_series(spark, sf), 10)


ORACLES["first_n_items"] = with_(*_WEEKLY, body="""
SELECT Item, "Date", q AS Quantity_Sold FROM weekly WHERE Item IN (SELECT DISTINCT Item FROM weekly ORDER BY Item LIMIT 10)""")


def lag_features(spark, sf):
    return views.lazy_series(spark, sf).withColumns(features.lag_columns((1, 2, 4, 8)))


ORACLES["lag_features"] = with_(*_WEEKLY, body=f"""
SELECT Item, "Date", q AS Quantity_Sold, {', '.join(f'lag(q, {n}) {_over()} AS Lag_{n}' for n in (1, 2, 4, 8))} FROM weekly""")


def rolling_features(spark, sf):
    return _round_all(views.lazy_series(spark, sf).withColumns(features.rolling_columns(4, 12)))


_ROLL = f"""avg(q) {_over('4 PRECEDING AND 1 PRECEDING')} AS Roll_Mean_4, avg(q) {_over('12 PRECEDING AND 1 PRECEDING')} AS Roll_Mean_12,
 stddev_samp(q) {_over('4 PRECEDING AND 1 PRECEDING')} AS Roll_Std_4, quantile_cont(q, 0.95) {_over('4 PRECEDING AND 1 PRECEDING')} AS Roll_Q95_4"""
ORACLES["rolling_features"] = with_(*_WEEKLY, body=f"""
SELECT Item, "Date", Quantity_Sold, round(Roll_Mean_4, 6) AS Roll_Mean_4, round(Roll_Mean_12, 6) AS Roll_Mean_12, round(Roll_Std_4, 6) AS Roll_Std_4,
 round(Roll_Q95_4, 6) AS Roll_Q95_4 FROM (SELECT Item, "Date", q AS Quantity_Sold, {_ROLL} FROM weekly)""")


def ewma_features(spark, sf):
    return _round_all(features.add_ewma(views.lazy_series(spark, sf), {"EWMA_4": 4, "EWMA_12": 12}))


VIEWS["rn"] = 'SELECT Item, "Date", q, row_number() OVER (PARTITION BY Item ORDER BY "Date") AS rn FROM weekly'
# The mean after row rn; a row's feature is the mean after the row before it.
VIEWS["ew"] = """
 SELECT Item, rn, q AS e4, q AS e8, q AS e12 FROM rn WHERE rn = 1 UNION ALL
 SELECT rn.Item, rn.rn, 0.6::DOUBLE * e4 + 0.4::DOUBLE * q, (7.0::DOUBLE / 9) * e8 + (2.0::DOUBLE / 9) * q, (11.0::DOUBLE / 13) * e12 + (2.0::DOUBLE / 13) * q
 FROM ew JOIN rn ON rn.Item = ew.Item AND rn.rn = ew.rn + 1"""
ORACLES["ewma_features"] = with_(*_WEEKLY, "rn", "ew", recursive=True, body="""
SELECT rn.Item, "Date", q AS Quantity_Sold, round(e4 + 1e-9, 6) AS EWMA_4, round(e12 + 1e-9, 6) AS EWMA_12
FROM rn LEFT JOIN ew ON ew.Item = rn.Item AND ew.rn = rn.rn - 1""")


def diff_features(spark, sf):
    return views.lazy_series(spark, sf).withColumns(features.difference_columns((1, 4, 7)))


ORACLES["diff_features"] = with_(*_WEEKLY, body=f"""
SELECT Item, "Date", q AS Quantity_Sold, {', '.join(f'q - lag(q, {n}) {_over()} AS Diff_{n}' for n in (1, 4, 7))},
 q - 2 * lag(q, 1) {_over()} + lag(q, 2) {_over()} AS Accel_2 FROM weekly""")


def trend_ratio(spark, sf):
    return _round_all(views.lazy_series(spark, sf).withColumns({
        "Recent_vs_Old_Trend": features.trend_ratio(4, 12), "Recent_vs_Old_Trend_8": features.trend_ratio(4, 8, 5.0)}))


def _trend_sql(short: int, long: int, cap: float) -> str:
    near, far = f"{short} PRECEDING AND 1 PRECEDING", f"{short + long} PRECEDING AND {short + 1} PRECEDING"
    return f"""CASE WHEN count(q) {_over(near)} = {short} AND count(q) {_over(far)} = {long}
 THEN least(greatest(avg(q) {_over(near)} / (avg(q) {_over(far)} + 1), 0.0), {cap}) END"""


ORACLES["trend_ratio"] = with_(*_WEEKLY, body=f"""
SELECT Item, "Date", q AS Quantity_Sold, round({_trend_sql(4, 12, 10.0)}, 6) AS Recent_vs_Old_Trend, round({_trend_sql(4, 8, 5.0)}, 6) AS Recent_vs_Old_Trend_8 FROM weekly""")


def event_surge(spark, sf):
    return _round_all(features.event_surge(views.lazy_series(spark, sf), EVENT))


_MEANS = f"""avg(q) FILTER ("Date" < DATE '{EVENT}') {{0}} AS pre, avg(q) FILTER ("Date" >= DATE '{EVENT}') {{0}} AS post"""
ORACLES["event_surge"] = with_(*_WEEKLY, body=f"""
SELECT Item, round(pre, 6) AS pre_mean, round(post, 6) AS post_mean, round(CASE WHEN post IS NULL THEN 1.0 ELSE post / (pre + 1) END, 6) AS surge
FROM (SELECT Item, {_MEANS.format('')} FROM weekly GROUP BY Item)""")


def event_surge_decay(spark, sf):
    return _round_all(views.lazy_series(spark, sf).withColumns({
        "Item_Surge": features.decayed_surge("hot ring", EVENT), "Rebrand_Surge": features.surge_ratio(EVENT, cap=2.0)}))


_SURGES = f"""CASE WHEN Item = 'hot ring' AND "Date" >= DATE '{EVENT}' AND pre IS NOT NULL THEN least(post / (pre + 1), 3.0)
 * greatest(0.3::DOUBLE, 1 - date_diff('day', DATE '{EVENT}', "Date") / 140.0::DOUBLE) ELSE 1.0 END AS Item_Surge,
 CASE WHEN post IS NULL THEN 1.0 ELSE least(post / (pre + 1), 2.0) END AS Rebrand_Surge"""
VIEWS["surged"] = f'SELECT *, {_MEANS.format("OVER (PARTITION BY Item)")} FROM weekly'
ORACLES["event_surge_decay"] = with_(*_WEEKLY, "surged", body=f"""
SELECT Item, "Date", q AS Quantity_Sold, round(Item_Surge, 6) AS Item_Surge, round(Rebrand_Surge, 6) AS Rebrand_Surge FROM (SELECT *, {_SURGES} FROM surged)""")


def item_codes(spark, sf):
    return series.item_codes(views.item_series(spark, sf))


ORACLES["item_codes"] = with_(*_WEEKLY, body="SELECT Item, dense_rank() OVER (ORDER BY Item) - 1 AS Item_Code FROM (SELECT DISTINCT Item FROM weekly)")


def weekly_features(spark, sf):
    return _round_all(features.create_features(views.item_series(spark, sf), "weekly", STAR_CALENDAR))


def _features_sql(source: str) -> str:
    """All weekly features over a view (Item, Date, q) whose running means are in ``ew``."""
    return f"""
SELECT *, dense_rank() OVER (ORDER BY Item) - 1 AS Item_Code FROM (
 SELECT f.Item, f."Date", f.q AS Quantity_Sold, {CALENDAR_SQL.format('f."Date"', 'origin')},
  round(coalesce(CASE WHEN post IS NULL THEN 1.0 ELSE post / (pre + 1) END, 0), 6) AS Post_Rebrand_Surge_Ratio,
  round(coalesce(trend, 0), 6) AS Recent_vs_Old_Trend, coalesce(l1, 0) AS Lag_1, coalesce(l2, 0) AS Lag_2, coalesce(l4, 0) AS Lag_4,
  round(coalesce(Roll_Mean_4, 0), 6) AS Roll_Mean_4, round(coalesce(Roll_Mean_12, 0), 6) AS Roll_Mean_12, round(coalesce(Roll_Std_4, 0), 6) AS Roll_Std_4,
  round(coalesce(Roll_Q95_4, 0), 6) AS Roll_Q95_4, round(coalesce(e4, 0) + 1e-9, 6) AS EWMA_4, round(coalesce(e12, 0) + 1e-9, 6) AS EWMA_12,
  coalesce(f.q - l1, 0) AS Diff_1, coalesce(f.q - 2 * l1 + l2, 0) AS Accel_2
 FROM (SELECT Item, "Date", q, min("Date") OVER () AS origin, {_MEANS.format('OVER (PARTITION BY Item)')}, {_trend_sql(4, 12, 10.0)} AS trend,
   lag(q, 1) {_over()} AS l1, lag(q, 2) {_over()} AS l2, lag(q, 4) {_over()} AS l4, {_ROLL}, row_number() {_over()} AS rn FROM {source}) f
 LEFT JOIN ew ON ew.Item = f.Item AND ew.rn = f.rn - 1)"""


ORACLES["weekly_features"] = with_(*_WEEKLY, "rn", "ew", recursive=True, body=_features_sql("weekly"))


def daily_features(spark, sf):
    """The daily feature set on the daily series."""
    return _round_all(features.create_features(views.item_series(spark, sf, "daily"), "daily", STAR_CALENDAR))


def _ewma_list(span: int, reach: int) -> str:
    a = 2.0 / (span + 1)
    return f"""list_reduce(list(q) {_over(f'{reach} PRECEDING AND 1 PRECEDING')}, lambda a, x: {1 - a!r}::DOUBLE * a + {a!r}::DOUBLE * x)"""


_DAILY_TREND = _trend_sql(7, 28, 10.0)
ORACLES["daily_features"] = with_("sales", "dailyseries", body=f"""
SELECT *, dense_rank() OVER (ORDER BY Item) - 1 AS Item_Code FROM (
 SELECT f.Item, f."Date", f.q AS Quantity_Sold, {CALENDAR_SQL.format('f."Date"', 'origin')},
  round(coalesce(CASE WHEN post IS NULL THEN 1.0 ELSE post / (pre + 1) END, 0), 6) AS Post_Rebrand_Surge_Ratio,
  round(coalesce(trend, 0), 6) AS Recent_vs_Old_Trend, coalesce(l1, 0) AS Lag_1, coalesce(l7, 0) AS Lag_7, coalesce(l14, 0) AS Lag_14,
  round(coalesce(m7, 0), 6) AS Roll_Mean_7, round(coalesce(m28, 0), 6) AS Roll_Mean_28, round(coalesce(s7, 0), 6) AS Roll_Std_7,
  round(coalesce(q7, 0), 6) AS Roll_Q95_7, round(coalesce(e7, 0) + 1e-9, 6) AS EWMA_7, round(coalesce(e28, 0) + 1e-9, 6) AS EWMA_28,
  coalesce(f.q - l1, 0) AS Diff_1, coalesce(f.q - 2 * l1 + l2, 0) AS Accel_2
 FROM (SELECT Item, "Date", q, min("Date") OVER () AS origin, {_MEANS.format('OVER (PARTITION BY Item)')}, {_DAILY_TREND} AS trend,
   lag(q, 1) {_over()} AS l1, lag(q, 2) {_over()} AS l2, lag(q, 7) {_over()} AS l7, lag(q, 14) {_over()} AS l14,
   avg(q) {_over('7 PRECEDING AND 1 PRECEDING')} AS m7, avg(q) {_over('28 PRECEDING AND 1 PRECEDING')} AS m28,
   stddev_samp(q) {_over('7 PRECEDING AND 1 PRECEDING')} AS s7, quantile_cont(q, 0.95) {_over('7 PRECEDING AND 1 PRECEDING')} AS q7,
   {_ewma_list(7, 150)} AS e7, {_ewma_list(28, 560)} AS e28 FROM dailyseries) f)""")


def future_grid(spark, sf):
    return series.future_grid(views.item_series(spark, sf), 12).select("Item", "Date")


_FUTURE = """SELECT Item, CAST(d AS DATE) AS "Date", 0.0::DOUBLE AS q FROM (SELECT DISTINCT Item FROM weekly),
 (SELECT unnest(generate_series(max("Date") + 7, max("Date") + 84, INTERVAL 7 DAY)) AS d FROM weekly)"""
ORACLES["future_grid"] = with_(*_WEEKLY, body=f'SELECT Item, "Date" FROM ({_FUTURE})')


def future_features(spark, sf):
    return _round_all(features.future_features(views.item_series(spark, sf), 12, "weekly", STAR_CALENDAR))


VIEWS["extended"] = f'SELECT Item, "Date", q FROM weekly UNION ALL SELECT * FROM ({_FUTURE})'
ORACLES["future_features"] = with_(*_WEEKLY, "extended", "rn", "ew", recursive=True, body=f"""
SELECT * FROM ({_features_sql('extended')}) WHERE "Date" > (SELECT max("Date") FROM weekly)""").replace("FROM weekly),\new", "FROM extended),\new")


def holdout_split(spark, sf):
    return series.holdout_split(views.item_series(spark, sf))


ORACLES["holdout_split"] = with_(*_WEEKLY, body='SELECT Item, "Date", q AS Quantity_Sold, "Date" >= max("Date") OVER () - 84 AS is_test FROM weekly')


def train_val_split(spark, sf):
    return series.train_val_split(views.item_series(spark, sf)).select("Item", "Date", "row", "is_val")


ORACLES["train_val_split"] = with_(*_WEEKLY, body="""
SELECT Item, "Date", rn AS row, rn > n - greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS is_val
FROM (SELECT Item, "Date", row_number() OVER (ORDER BY Item, "Date") AS rn, count(*) OVER () AS n FROM weekly)""")


def item_model_eligibility(spark, sf):
    return series.model_eligibility(views.lazy_series(spark, sf), 100)


ORACLES["item_model_eligibility"] = with_(*_WEEKLY, body="SELECT Item, count(*) AS records, count(*) >= 100 AS own_model FROM weekly GROUP BY Item")


def dow_factors(spark, sf):
    factors = features.weekday_factors(views.lazy_series(spark, sf, "daily"))
    return _round_all(features.weekday_factor_matrix(factors))


VIEWS["factors"] = """
 SELECT Item, d, coalesce(sum(q) / count(*) / nullif(any_value(m), 0), 1.0) AS f FROM (
  SELECT Item, isodow("Date") - 1 AS d, q, sum(q) OVER (PARTITION BY Item) / count(*) OVER (PARTITION BY Item) AS m FROM dailyseries) GROUP BY 1, 2"""
ORACLES["dow_factors"] = with_("sales", "dailyseries", "factors", body=f"""
SELECT Item, {', '.join(f'round(coalesce(max(f) FILTER (d = {d}), 1.0), 6) AS dow_{d}' for d in range(7))} FROM factors GROUP BY Item""")


def dow_adjust(spark, sf):
    """A 28-day mean as raw forecast, adjusted by weekday."""
    daily = views.item_series(spark, sf, "daily")
    raw = daily.withColumns({"Raw_Pred": features.rolling_columns(7, 28)["Roll_Mean_28"]}).where(F.col("Raw_Pred").isNotNull())
    return _round_all(features.apply_weekday_factors(raw, features.weekday_factors(daily))).select(
        "Item", "Date", "DOW", "Raw_Pred", "dow_factor", "Predicted")


ORACLES["dow_adjust"] = with_("sales", "dailyseries", "factors", body=f"""
SELECT r.Item, "Date", isodow("Date") - 1 AS DOW, round(raw, 6) AS Raw_Pred, round(coalesce(f, 1.0), 6) AS dow_factor, round_even(raw * coalesce(f, 1.0), 0) AS Predicted
FROM (SELECT Item, "Date", avg(q) {_over('28 PRECEDING AND 1 PRECEDING')} AS raw FROM dailyseries) r LEFT JOIN factors f ON f.Item = r.Item AND f.d = isodow("Date") - 1
WHERE raw IS NOT NULL""")

_CLIPPED = ("Quantity_Sold", "Lag_1", "Roll_Mean_8", "Roll_Std_8", "Diff_4", "Recent_vs_Old_Trend", "Rebrand_Surge")


def winsorize(spark, sf):
    columns = features.exploratory_columns("weekly", STAR_CALENDAR, "hot ring")
    frame = views.item_series(spark, sf).withColumns({c: columns[c] for c in _CLIPPED[1:]})
    return _round_all(features.winsorise(materialise(features.zero_missing(frame)), _CLIPPED))


_EXPLORE = f"""SELECT Item, "Date", q AS Quantity_Sold, coalesce(lag(q, 1) {_over()}, 0) AS Lag_1, coalesce(avg(q) {_over('8 PRECEDING AND 1 PRECEDING')}, 0) AS Roll_Mean_8,
 coalesce(stddev_samp(q) {_over('8 PRECEDING AND 1 PRECEDING')}, 0) AS Roll_Std_8, coalesce(q - lag(q, 4) {_over()}, 0) AS Diff_4,
 coalesce({_trend_sql(4, 8, 5.0)}, 0) AS Recent_vs_Old_Trend, coalesce(CASE WHEN post IS NULL THEN 1.0 ELSE least(post / (pre + 1), 2.0) END, 0) AS Rebrand_Surge FROM surged"""
ORACLES["winsorize"] = with_(*_WEEKLY, "surged", body=f"""
, x AS ({_EXPLORE}), b AS (SELECT {', '.join(f'quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}' for c in _CLIPPED)} FROM x)
SELECT Item, "Date", {', '.join(f'round(greatest(lo_{c}, least(hi_{c}, {c})), 6) + 0.0 AS {c}' for c in _CLIPPED)} FROM x, b""")


def exploratory_features(spark, sf):
    """The whole exploratory feature frame, winsorised."""
    return _round_all(features.exploratory_features(views.item_series(spark, sf), "weekly", STAR_CALENDAR, "hot ring"))


_FRAME = f"""SELECT f.*, e4 AS EWMA_4, e8 AS EWMA_8 FROM (
 SELECT Item, "Date", {CALENDAR_SQL.format('"Date"', 'origin')}, {EXTENDED_SQL.format('"Date"', 'origin')}, q AS Quantity_Sold,
  {', '.join(f'lag(q, {n}) {_over()} AS Lag_{n}' for n in (1, 2, 4, 8))}, {', '.join(f"avg(q) {_over(f'{n} PRECEDING AND 1 PRECEDING')} AS Roll_Mean_{n}" for n in (4, 8, 12))},
  {', '.join(f"stddev_samp(q) {_over(f'{n} PRECEDING AND 1 PRECEDING')} AS Roll_Std_{n}" for n in (4, 8))}, q - lag(q, 1) {_over()} AS Diff_1, q - lag(q, 4) {_over()} AS Diff_4,
  {_trend_sql(4, 8, 5.0)} AS Recent_vs_Old_Trend, {_SURGES}, row_number() {_over()} AS rn FROM (SELECT *, min("Date") OVER () AS origin FROM surged)) f
 LEFT JOIN ew ON ew.Item = f.Item AND ew.rn = f.rn - 1"""
_EXPLORED = (
    "Quantity_Sold", *features.CALENDAR_FEATURES, "Quarter", "Is_Weekend", "Sin_Month", "Cos_Month", "Days_Since_Start", "Day_Of_Month",
    "Is_Payday", "Is_Near_Holiday", "Days_Since_Rebrand", "Payday_Weekend", "Holiday_Weekend", "Lag_1", "Lag_2", "Lag_4", "Lag_8",
    "Roll_Mean_4", "Roll_Mean_8", "Roll_Mean_12", "Roll_Std_4", "Roll_Std_8", "EWMA_4", "EWMA_8", "Diff_1", "Diff_4",
    "Recent_vs_Old_Trend", "Item_Surge", "Rebrand_Surge",
)


def _settled(c: str) -> str:
    lift = " + 1e-9" if c.startswith("EWMA") else ""
    return f'round(greatest("lo_{c}", least("hi_{c}", "{c}")){lift}, 6) + 0.0 AS "{c}"'


ORACLES["exploratory_features"] = with_(*_WEEKLY, "rn", "ew", "surged", recursive=True, body=f"""
, x AS (SELECT Item, "Date", {', '.join(f'coalesce("{c}", 0)::DOUBLE AS "{c}"' for c in _EXPLORED)} FROM ({_FRAME})),
b AS (SELECT {', '.join(f'quantile_cont("{c}", 0.05) AS "lo_{c}", quantile_cont("{c}", 0.95) AS "hi_{c}"' for c in _EXPLORED)} FROM x)
SELECT Item, "Date", dense_rank() OVER (ORDER BY Item) - 1 AS Item_Code, {', '.join(map(_settled, _EXPLORED))} FROM x, b""")

QUERIES |= {name: globals()[name] for name in ORACLES}

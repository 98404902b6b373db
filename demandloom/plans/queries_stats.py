"""Queries over the daily total series."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.numeric import rounded
from demandloom.operators import stats
from demandloom.plans import views
from demandloom.plans.oracle_views import with_
from demandloom.session import materialise

QUERIES, ORACLES = {}, {}
_TOTALS = ("sales", "totals")
_NUM = ("sales", "totals", "numbered")


def _round(df, digits=6):
    return df.withColumns({c: rounded(c, digits) for c, kind in df.dtypes if kind == "double"})


def _named(df):
    """The levels go by the name of the totals."""
    return _round(df.withColumn("series", F.when(F.col("series") == "levels", "totals").otherwise(F.col("series"))))


def moving_averages(spark, sf):
    return _round(stats.moving_averages(views.totals(spark, sf)))


def _ma(n: int) -> str:
    frame = f'OVER (ORDER BY "Date" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'
    return f"round(CASE WHEN count(*) {frame} = {n} THEN avg(q) {frame} END, 6) AS ma_{n}"


ORACLES["moving_averages"] = with_(*_TOTALS, body=f'SELECT "Date", q AS Quantity_Sold, {_ma(7)}, {_ma(30)} FROM totals')


def differenced_totals(spark, sf):
    return stats.differenced(views.totals(spark, sf))


ORACLES["differenced_totals"] = with_(*_TOTALS, body='SELECT * FROM (SELECT "Date", q - lag(q) OVER (ORDER BY "Date") AS Quantity_Sold FROM totals) WHERE Quantity_Sold IS NOT NULL')


def autocorrelation(spark, sf):
    return _round(stats.autocorrelation(views.totals(spark, sf)))


ORACLES["autocorrelation"] = with_(*_NUM, body="""
SELECT k AS lag, round(corr(a.q, b.q), 6) AS correlation, abs(corr(a.q, b.q)) > 0.2 AS significant
FROM numbered a, generate_series(1, 30) t(k), numbered b WHERE b.i = a.i - k GROUP BY k""")


def acf(spark, sf):
    """Autocorrelation function of the totals and of their differences."""
    return _named(stats.acf(views.totals(spark, sf)))


_ACF = """SELECT '{1}' AS series, k AS lag, round(sum((a.q - m) * (b.q - m)) / any_value(v), 6) AS acf
FROM (SELECT *, avg(q) OVER () AS m, var_pop(q) OVER () * count(*) OVER () AS v FROM {0}) a, generate_series(0, 30) t(k), {0} b WHERE b.i = a.i - k GROUP BY k"""
ORACLES["acf"] = with_(*_NUM, body=f"""
, dif AS (SELECT i, q - lag(q) OVER (ORDER BY i) AS q FROM numbered QUALIFY i > 1)
{_ACF.format('numbered', 'totals')} UNION ALL {_ACF.format('dif', 'differences')}""")


def linear_trend(spark, sf):
    return _round(stats.linear_trend(views.totals(spark, sf)))


_TREND = """SELECT regr_slope(q, i - 1) AS slope, regr_intercept(q, i - 1) AS intercept, regr_r2(q, i - 1) AS r_squared, count(*) AS days FROM numbered"""
# The tail as one minus the area under the density, by Simpson's rule over the angle atan(t / sqrt(v)).
_AREA = """SELECT top / 60000 * sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * k / 20000), v - 1)) AS area
 FROM (SELECT atan(abs(ts) / sqrt(days - 2)) AS top, (days - 2)::DOUBLE AS v FROM z), generate_series(0, 20000) g(k) GROUP BY top, v"""
ORACLES["linear_trend"] = with_(*_NUM, body=f"""
, t AS ({_TREND}), z AS (SELECT *, sign(slope) * sqrt(r_squared * (days - 2) / (1 - r_squared)) AS ts FROM t), a AS ({_AREA})
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, days, round(ts, 6) AS t_statistic,
 CASE WHEN slope > 0 THEN 'Increasing' WHEN slope < 0 THEN 'Decreasing' ELSE 'Flat' END AS direction,
 round(greatest(0, 1 - 2 * exp(lgamma((days - 1) / 2.0) - lgamma((days - 2) / 2.0)) / sqrt(pi()) * area), 6) + 0.0 AS p_value FROM z, a""")


def seasonal_decompose(spark, sf):
    return _round(stats.seasonal_decompose(views.totals(spark, sf)))


ORACLES["seasonal_decompose"] = with_(*_NUM, body="""
, m AS (SELECT "Date", q, i, CASE WHEN count(*) OVER w = 7 THEN avg(q) OVER w END AS mid, count(*) OVER () AS n FROM numbered WINDOW w AS (ORDER BY "Date" ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
ends AS (SELECT regr_slope(mid, i) FILTER (i BETWEEN 4 AND 10) AS b0, regr_intercept(mid, i) FILTER (i BETWEEN 4 AND 10) AS a0,
  regr_slope(mid, i) FILTER (i BETWEEN n - 9 AND n - 3) AS b1, regr_intercept(mid, i) FILTER (i BETWEEN n - 9 AND n - 3) AS a1 FROM m),
t AS (SELECT "Date", q, (i - 1) % 7 AS phase, CASE WHEN mid IS NOT NULL THEN mid WHEN i <= 3 THEN a0 + b0 * i ELSE a1 + b1 * i END AS trend FROM m, ends),
p AS (SELECT phase, avg(q - trend) AS raw FROM t GROUP BY 1), s AS (SELECT phase, raw - (SELECT avg(raw) FROM p) AS seasonal FROM p)
SELECT "Date", q AS Quantity_Sold, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(q - trend - seasonal, 6) + 0.0 AS residual FROM t JOIN s USING (phase)""")


def kpss_stat(spark, sf):
    return _round(stats.kpss(views.totals(spark, sf)))


_KPSS = """(WITH r AS (SELECT i, q - avg(q) OVER () AS r, count(*) OVER () AS n FROM {source}),
g AS (SELECT k, sum(a.r * b.r) AS s FROM r a, generate_series(0, 2500) t(k), r b WHERE b.i = a.i - k GROUP BY k),
n AS (SELECT any_value(n)::DOUBLE AS n FROM r),
w AS (SELECT CAST(floor(pow(n, 2.0 / 9)) AS BIGINT) AS w FROM n),
ss AS (SELECT sum(CASE WHEN k = 0 THEN s / n ELSE 2 * s / n END) AS s0, sum(2 * k * s / n) AS s1 FROM g, n, w WHERE k <= w),
l AS (SELECT CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0::DOUBLE / 3) * pow(n, 1.0::DOUBLE / 3)) AS INTEGER) AS lags FROM ss, n),
v AS (SELECT sum(CASE WHEN k = 0 THEN s ELSE 2 * (1 - k / (lags + 1.0::DOUBLE)) * s END) / any_value(n) AS v, any_value(lags) AS lags FROM g, l, n WHERE k <= lags),
c AS (SELECT sum(r) OVER (ORDER BY i) AS c FROM r),
st AS (SELECT sum(c * c) / (any_value(n) * any_value(n)) / any_value(v) AS stat, any_value(lags) AS lags FROM c, n, v),
pv AS (SELECT *, CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) * 0.05 / 0.116 WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) * 0.025 / 0.111
  WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS p FROM st)
SELECT round(stat, 6) AS statistic, lags, round(p, 6) AS p_value, p > 0.05 AS stationary, '{series}' AS series FROM pv)"""
ORACLES["kpss_stat"] = with_(*_NUM, body=f"""
, steps AS (SELECT i - 1 AS i, d AS q FROM (SELECT i, q - lag(q) OVER (ORDER BY i) AS d FROM numbered) WHERE d IS NOT NULL)
{_KPSS.format(source="numbered", series="levels")} UNION ALL {_KPSS.format(source="steps", series="differences")}""")


def outliers(spark, sf):
    return _round(stats.outliers(views.totals(spark, sf)))


_OUT = """SELECT "Date", q, (q - m) / s AS z, q - m AS dev, abs((q - m) / s) > 3 AS iz, q < q1 - 1.5 * (q3 - q1) OR q > q3 + 1.5 * (q3 - q1) AS iq
FROM totals, (SELECT avg(q) AS m, stddev_pop(q) AS s, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.75) AS q3 FROM totals)"""
ORACLES["outliers"] = with_(*_TOTALS, body=f"""
SELECT "Date", q AS Quantity_Sold, round(z, 6) + 0.0 AS z_score, round(dev, 6) + 0.0 AS deviation_from_mean, iz AS is_z_outlier, iq AS is_iqr_outlier FROM ({_OUT})""")


def subseries(spark, sf):
    return _round(stats.subseries(views.totals(spark, sf)))


ORACLES["subseries"] = with_(*_TOTALS, body="""
SELECT month("Date") AS month, day("Date") AS day, round(avg(q), 6) AS mean_quantity, count(*) AS days FROM totals GROUP BY 1, 2""")


def eda_flags(spark, sf):
    return _round(stats.eda_flags(views.totals(spark, sf)))


ORACLES["eda_flags"] = with_(*_NUM, body=f"""
SELECT CASE WHEN slope > 0 THEN 'Increasing' WHEN slope < 0 THEN 'Decreasing' ELSE 'Flat' END AS trend,
 (SELECT CASE WHEN stddev_samp(m) > avg(m) * 0.1 THEN 'Present' ELSE 'Weak' END FROM (SELECT avg(q) AS m FROM totals GROUP BY isodow("Date"))) AS weekly_seasonality,
 (SELECT count(*) FILTER (iq) FROM ({_OUT})) AS outlier_days, (SELECT round(100.0 * avg(CAST(iq AS DOUBLE)), 6) FROM ({_OUT})) AS outlier_pct FROM ({_TREND})""")


def item_correlation(spark, sf):
    return _round(stats.item_correlation(materialise(views.daily_quantity(spark, sf))))


ORACLES["item_correlation"] = with_("sales", body="""
, d AS (SELECT "Date", Item, sum(q) AS q FROM sales GROUP BY 1, 2), best AS (SELECT Item FROM d GROUP BY 1 ORDER BY sum(q) DESC, Item LIMIT 100),
g AS (SELECT days."Date", best.Item, coalesce(d.q, 0.0) AS q FROM (SELECT DISTINCT "Date" FROM d WHERE Item IN (SELECT Item FROM best)) days CROSS JOIN best LEFT JOIN d ON d."Date" = days."Date" AND d.Item = best.Item)
SELECT a.Item AS item_a, b.Item AS item_b, round(corr(a.q, b.q), 6) AS correlation FROM g a JOIN g b ON a."Date" = b."Date" AND a.Item < b.Item GROUP BY 1, 2""")


def pacf(spark, sf):
    """Partial autocorrelation of the totals and of their differences."""
    return _named(stats.pacf(views.totals(spark, sf)))


# Durbin and Levinson's recursion over lists: the weights of order k, from which those of order k + 1 follow.
_PACF = """(WITH RECURSIVE c AS (SELECT list(q - m ORDER BY i) AS c FROM (SELECT i, q, avg(q) OVER () AS m FROM {0})),
r AS (SELECT list(list_dot_product(c[k + 1:], c[:len(c) - k]) / (len(c) - k) / (list_dot_product(c, c) / len(c)) ORDER BY k) AS r FROM c, generate_series(0, 30) t(k)),
w(k, phi) AS (
 SELECT 0, []::DOUBLE[] UNION ALL
 SELECT k + 1, list_append(list_transform(phi, lambda x, j: x - step * phi[k - j + 1]), step) FROM (
  SELECT k, phi, (r[k + 2] - CASE WHEN k = 0 THEN 0 ELSE list_dot_product(phi, list_reverse(r[2:k + 1])) END)
   / (1 - CASE WHEN k = 0 THEN 0 ELSE list_dot_product(phi, r[2:k + 1]) END) AS step FROM w, r WHERE k < 30))
SELECT k AS lag, round(CASE WHEN k = 0 THEN 1 ELSE phi[k] END, 6) + 0.0 AS pacf, '{1}' AS series FROM w)"""
_DIF = "dif AS (SELECT i - 1 AS i, d AS q FROM (SELECT i, q - lag(q) OVER (ORDER BY i) AS d FROM numbered) WHERE d IS NOT NULL)"
ORACLES["pacf"] = with_(*_NUM, body=f", {_DIF} {_PACF.format('numbered', 'totals')} UNION ALL {_PACF.format('dif', 'differences')}")


def adf_stat(spark, sf):
    return _round(stats.adf(views.totals(spark, sf)))


def _eliminated(name: str, start: str, steps: str) -> str:
    """A recursive view: a matrix of lists, from which one row after the other is eliminated."""
    return f"""{name}(p, m) AS (
 SELECT 0, m FROM {start} UNION ALL
 SELECT p + 1, list_transform(m, lambda a, j: CASE WHEN j = p + 1 THEN a ELSE list_transform(a, lambda x, k: x - a[p + 1] * m[p + 1][k] / m[p + 1][p + 1]) END)
 FROM {name}, {steps} WHERE p < n)"""


# Normal equations over common rows; eliminating constant, level and one past change after the other leaves, in the
# corner, the squared error of each lag length. With the best one, the level is eliminated last.
_ADF = """(WITH RECURSIVE v AS (SELECT list(q::DOUBLE ORDER BY i) AS y FROM {0}),
d AS (SELECT y, list_transform(y[2:], lambda x, j: x - y[j]) AS d, len(y) AS n FROM v),
most AS (SELECT *, least(CAST(ceil(12 * pow(n / 100.0, 0.25)) AS INT), CAST(n // 2 - 2 AS INT)) AS most FROM d),
-- 0 the constant, 1 the level, 2 and on the past changes, last the change itself
cols AS (SELECT j, CASE WHEN j = 0 THEN list_transform(d[most + 1:], lambda x: 1.0::DOUBLE) WHEN j = 1 THEN list_transform(y[most + 1:n - 1], lambda x: x - list_avg(y))
  WHEN j = most + 2 THEN d[most + 1:] ELSE d[most + 2 - j:n - j] END AS c FROM most, generate_series(0, most + 2) t(j)),
gram AS (SELECT list(a ORDER BY j) AS m FROM (SELECT x.j, list(list_dot_product(x.c, z.c) ORDER BY z.j) AS a FROM cols x, cols z GROUP BY x.j)),
one AS (SELECT most + 2 AS n FROM most),
""" + _eliminated("e", "gram", "one") + """,
fits AS (SELECT p - 2 AS lags, r * (ln(2 * pi()) + ln(m[-1][-1] / r) + 1) + 2 * p AS aic FROM e, (SELECT n - 1 - most AS r FROM most) WHERE p >= 2),
best AS (SELECT arg_min(lags, aic) AS b FROM fits),
own AS (SELECT j, b, n - 1 - b AS r, CASE WHEN j = 0 THEN list_transform(d[b + 1:], lambda x: 1.0::DOUBLE) WHEN j = b + 1 THEN list_transform(y[b + 1:n - 1], lambda x: x - list_avg(y))
  WHEN j = b + 2 THEN d[b + 1:] ELSE d[b + 1 - j:n - 1 - j] END AS c FROM most, best, generate_series(0, b + 2) t(j)),
gram2 AS (SELECT list(a ORDER BY j) AS m FROM (SELECT x.j, list(list_dot_product(x.c, z.c) ORDER BY z.j) AS a FROM own x, own z GROUP BY x.j)),
two AS (SELECT b + 1 AS n FROM best),
""" + _eliminated("f", "gram2", "two") + """,
last AS (SELECT m[-2][-1] / m[-2][-2] AS beta, m[-2][-2] AS xx, m[-1][-1] - m[-2][-1] * m[-2][-1] / m[-2][-2] AS rss FROM f, two WHERE p = n),
st AS (SELECT beta / sqrt(rss / (r - b - 2) / xx) AS t, b, r FROM last, (SELECT any_value(b) AS b, any_value(r) AS r FROM own)),
pv AS (SELECT *, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0 ELSE 1 END AS edge,
 CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * pow(t, 3) END::DOUBLE AS z FROM st),
-- normal probability by Simpson's rule
area AS (SELECT sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * k / 20000, 2) / 2)) * z / 60000 / sqrt(2 * pi()) + 0.5 AS p FROM pv, generate_series(0, 20000) g(k) GROUP BY z),
fin AS (SELECT t, b, r, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0 ELSE p END::DOUBLE AS p FROM pv, area)
SELECT round(t, 6) AS statistic, CAST(b AS INT) AS lags, CAST(r AS INT) AS rows, -3.43035::DOUBLE AS critical_1, -2.86154::DOUBLE AS critical_5, -2.56677::DOUBLE AS critical_10,
 round(p, 6) + 0.0 AS p_value, p < 0.05 AS stationary, '{1}' AS series FROM fin)"""
ORACLES["adf_stat"] = with_(*_NUM, body=f", {_DIF} {_ADF.format('numbered', 'levels')} UNION ALL {_ADF.format('dif', 'differences')}")

QUERIES |= {name: globals()[name] for name in ORACLES}

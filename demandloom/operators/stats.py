"""Exploratory statistics of the daily total series.

The input is one row per calendar day (a century is 36,525 rows), so a window without a partition
key, or one buffer of all values, is bounded by the calendar and not by the sales behind it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.numeric import safe_ratio

# Level-stationarity critical values and their p-values.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
# Asymptotic critical values of the unit-root test with a constant.
ADF_CRITICAL = {"1%": -3.43035, "5%": -2.86154, "10%": -2.56677}
# MacKinnon's (1994) response surface for its p-value: range, turning point, and polynomials
# in the statistic (constant first) below and above the turning point, whose normal probability is the value.
ADF_RANGE, ADF_TURN = (-18.83, 2.74), -1.61
ADF_BELOW, ADF_ABOVE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p_value(statistic: float) -> float:
    if statistic > ADF_RANGE[1]:
        return 1.0
    if statistic < ADF_RANGE[0]:
        return 0.0
    terms = ADF_BELOW if statistic <= ADF_TURN else ADF_ABOVE
    return 0.5 * math.erfc(-sum(c * statistic**k for k, c in enumerate(terms)) / math.sqrt(2.0))


def _by_date() -> Window:
    return Window.orderBy("Date")


def numbered(totals: DataFrame) -> DataFrame:
    """Zero-based position ``i`` in date order."""
    return totals.withColumn("i", F.row_number().over(_by_date()) - 1)


def moving_averages(totals: DataFrame, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing means, NULL until the window is full."""
    q = "Quantity_Sold"

    def mean(n: int) -> Column:
        frame = _by_date().rowsBetween(-(n - 1), 0)
        return F.when(F.count(q).over(frame) == n, F.avg(q).over(frame))

    return totals.withColumns({f"ma_{n}": mean(n) for n in lengths})


def differenced(totals: DataFrame) -> DataFrame:
    """First differences; the first day has none and is left out."""
    step = F.col("Quantity_Sold") - F.lag("Quantity_Sold", 1).over(_by_date())
    return totals.select("Date", step.alias("Quantity_Sold")).where(F.col("Quantity_Sold").isNotNull())


def _lagged(totals: DataFrame, lags: int) -> DataFrame:
    """One window pass with every lag as a column."""
    return totals.withColumns({
        f"lag_{k}": F.lag("Quantity_Sold", k).over(_by_date()) for k in range(1, lags + 1)
    })


def _stacked(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    """A one-row frame of columns as (key, value) rows."""
    cells = F.array(*[F.struct(F.lit(k).alias(key), F.col(c).alias(value)) for k, c in enumerate(names)])
    return row.select(F.explode(cells).alias("cell")).select(f"cell.{key}", f"cell.{value}")


def autocorrelation(totals: DataFrame, lags: int = 30, threshold: float = 0.2) -> DataFrame:
    """Pairwise correlation of the series with its own lags, and which are marked."""
    row = _lagged(totals, lags).agg(*[
        F.corr("Quantity_Sold", f"lag_{k}").alias(f"c_{k}") for k in range(1, lags + 1)
    ])
    found = _stacked(row, [f"c_{k}" for k in range(1, lags + 1)], "lag", "correlation")
    return found.select(
        (F.col("lag") + 1).alias("lag"), "correlation",
        (F.abs("correlation") > threshold).alias("significant"),
    )


def series_of(totals: DataFrame, kinds: Sequence[str], statistic: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """The rows of ``statistic`` for each kind of series, levels or differences, from one pass over the totals.

    All lag products of a series come from the one list of its values, as long as the calendar.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for values in frame["q"]:
                found = {"levels": np.asarray(values, float)}
                found["differences"] = np.diff(found["levels"])
                for kind in kinds:
                    yield pd.DataFrame(statistic(found[kind])).assign(series=kind)

    listed = totals.agg(F.array_sort(F.collect_list(F.struct("Date", "Quantity_Sold"))).alias("s"))
    return listed.select(F.transform("s", lambda x: x["Quantity_Sold"].cast("double")).alias("q")).mapInPandas(run, f"{schema}, series string")


def lag_products(values: np.ndarray, lags: int) -> np.ndarray:
    """Sums of the products of the deviations with those 0, 1, ... ``lags`` places before."""
    r = values - values.mean() if len(values) else values
    return np.array([r[k:] @ r[:len(r) - k] if k < len(r) else 0.0 for k in range(lags + 1)])


BOTH = ("levels", "differences")


def acf(totals: DataFrame, lags: int = 30, kinds: Sequence[str] = BOTH) -> DataFrame:
    """Autocorrelation function: lagged products over the total sum of squares."""
    def one(values: np.ndarray) -> dict:
        sums = lag_products(values, lags)
        return {"lag": range(lags + 1), "acf": sums / sums[0] if sums[0] else [None] * (lags + 1)}

    return series_of(totals, kinds, one, "lag int, acf double")


def durbin_levinson(rho: np.ndarray) -> list[float]:
    """Partial autocorrelations from autocorrelations, both from lag 0."""
    partial, weights = [1.0], np.zeros(0)
    for k in range(1, len(rho)):
        past = rho[1:k]
        step = (rho[k] - weights @ past[::-1]) / (1.0 - weights @ past)
        weights = np.append(weights - step * weights[::-1], step)
        partial.append(step)
    return partial


def pacf(totals: DataFrame, lags: int = 30, kinds: Sequence[str] = BOTH) -> DataFrame:
    """Partial autocorrelation from the adjusted autocorrelation, by Durbin and Levinson's recursion."""
    def one(values: np.ndarray) -> dict:
        n = len(values)
        most = min(lags, n - 1)
        sums = lag_products(values, most)
        found = durbin_levinson(sums / (n - np.arange(most + 1)) / (sums[0] / n)) if most >= 0 and sums[0] else [None] * (most + 1)
        return {"lag": range(most + 1), "pacf": found}

    return series_of(totals, kinds, one, "lag int, pacf double")


def linear_trend(totals: DataFrame) -> DataFrame:
    """Least-squares line through the totals by day number.

    The p-value is the two-sided tail of the slope's t statistic under Student's distribution.
    """
    y, x = F.col("Quantity_Sold"), F.col("i").cast("double")
    fitted = numbered(totals).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"), F.count(y).alias("days"),
    )
    t = F.sqrt(safe_ratio(F.col("r_squared") * (F.col("days") - 2), F.lit(1.0) - F.col("r_squared")))
    return fitted.withColumns({
        "t_statistic": F.signum("slope") * t,
        "direction": F.when(F.col("slope") > 0, "Increasing").when(F.col("slope") < 0, "Decreasing").otherwise("Flat"),
    }).withColumn("p_value", student_tail(F.abs("t_statistic"), F.col("days") - 2))


# Coefficients of Stirling's series of the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
# Steps of the continued fraction, enough for double precision.
FRACTION_STEPS = 60


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series 8 steps further up."""
    up = x + F.lit(8.0)
    series = (up - 0.5) * F.log(up) - up + F.lit(0.5 * math.log(2 * math.pi))
    for k, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(up, F.lit(2.0 * k + 1))
    below = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda total, k: total + F.log(x + k))
    return series - below


def student_tail(t: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's distribution at ``t`` >= 0: the incomplete beta function of v/(v+t*t) at v/2 and 1/2.

    Its continued fraction is evaluated from the inner end, on the side where it converges fast. NULL without a
    degree of freedom or a statistic.
    """
    v = freedom.cast("double")

    def fraction(a: Column, b: Column, x: Column) -> Column:
        """The incomplete beta function over its front factor."""
        def step(inner, k):
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / inner

        return 1 / (F.aggregate(F.sequence(F.lit(FRACTION_STEPS), F.lit(1)), F.lit(1.0), step) * a)

    half, a = F.lit(0.5), v / 2
    x = v / (v + t * t)
    front = F.exp(_log_gamma(a + half) - _log_gamma(a) - F.lit(math.lgamma(0.5)) + a * F.log(x) + half * F.log(t * t / (v + t * t)))
    near = x < (a + 1) / (a + 2.5)
    tail = F.when(near, front * fraction(a, half, x)).otherwise(1 - front * fraction(half, a, 1 - x))
    return F.when((v > 0) & t.isNotNull(), F.when(t == 0, F.lit(1.0)).when(F.isnan(t) | (x == 0), F.lit(0.0)).otherwise(tail))


def seasonal_decompose(totals: DataFrame, period: int = 7) -> DataFrame:
    """Additive parts: centred mean, phase means of the rest (summing to zero), and the residual.

    At the ends, where the centred mean is not defined, the trend follows the straight line through the
    nearest ``period`` defined values. A series of one period or less has no trend.
    """
    half = period // 2
    frame = _by_date().rowsBetween(-half, half)
    q = F.col("Quantity_Sold")
    centred = numbered(totals).withColumn("centred", F.when(F.count(q).over(frame) == period, F.avg(q).over(frame)))
    last = totals.agg(F.count(F.lit(1))).scalar() - 1

    def line(inside: Column) -> Column:
        x, y = F.when(inside, F.col("i")), F.when(inside, F.col("centred"))
        fit = centred.agg(F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))).scalar()
        return fit["intercept"] + fit["slope"] * F.col("i")

    start = line(F.col("i").between(half, half + period - 1))
    end = line(F.col("i").between(last - half - period + 1, last - half))
    trended = centred.withColumn(
        "trend", F.coalesce("centred", F.when(F.col("i") < half, start).otherwise(end))
    ).withColumn("phase", F.col("i") % period).drop("centred")
    phases = trended.groupBy("phase").agg(F.avg(q - F.col("trend")).alias("raw"))
    centre = phases.agg(F.avg("raw")).scalar()
    seasonal = phases.select("phase", (F.col("raw") - centre).alias("seasonal"))
    return trended.join(seasonal, "phase").select(
        "Date", "Quantity_Sold", "trend", "seasonal",
        (q - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def kpss(totals: DataFrame, kinds: Sequence[str] = BOTH) -> DataFrame:
    """Level-stationarity statistic with the data-driven lag length, and its table p-value; NULL for a constant series."""
    def one(values: np.ndarray) -> dict:
        n = len(values)
        wide = int(n ** (2.0 / 9.0))
        first = lag_products(values, wide)
        s0 = first[0] / n + 2.0 * first[1:].sum() / n if n else 0.0
        s1 = 2.0 * (np.arange(1, wide + 1) * first[1:]).sum() / n if n else 0.0
        gamma = 1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) if s0 else 0.0
        lags = max(0, min(int(gamma * n ** (1.0 / 3.0)), n - 1))
        sums = lag_products(values, lags)
        long_run = (sums[0] + 2.0 * ((1.0 - np.arange(1, lags + 1) / (lags + 1.0)) * sums[1:]).sum()) / n if n else 0.0
        walk = np.cumsum(values - values.mean()) if n else values
        return {"statistic": [walk @ walk / n**2 / long_run if long_run else None], "lags": [lags]}

    return series_of(totals, kinds, one, "statistic double, lags int").withColumn(
        "p_value", _interpolated(F.col("statistic"), KPSS_CRITICAL)).withColumn("stationary", F.col("p_value") > 0.05).select(
        "statistic", "lags", "p_value", "stationary", "series")


def _interpolated(x: Column, table: tuple[tuple[float, float], ...]) -> Column:
    """Linear interpolation, flat beyond the ends."""
    value = F.lit(table[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(table, table[1:]))):
        inside = F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        value = F.when(x <= x1, inside).otherwise(value)
    return F.when(x <= table[0][0], F.lit(table[0][1])).otherwise(value)


def _unit_root_fit(values: np.ndarray, lags: int, skipped: int) -> tuple[float, float, int]:
    """AIC, t statistic of the level and number of rows of the test's regression with ``lags`` past changes.

    The first ``skipped`` changes have too few before them.
    """
    change = np.diff(values)
    y = change[skipped:]
    x = np.column_stack([np.ones(len(y)), values[skipped:-1], *[change[skipped - k:len(change) - k] for k in range(1, lags + 1)]])
    # The columns on one scale, which leaves the statistic as it is.
    scale = np.sqrt((x * x).sum(axis=0))
    scale[scale == 0] = 1.0
    x = x / scale
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ (x.T @ y)
    rest = y - x @ beta
    rss, rows = rest @ rest, len(y)
    aic = rows * (math.log(2 * math.pi) + math.log(rss / rows) + 1) + 2 * x.shape[1]
    return aic, beta[1] / math.sqrt(rss / (rows - x.shape[1]) * inverse[1, 1]), rows


def adf(totals: DataFrame, kinds: Sequence[str] = BOTH) -> DataFrame:
    """Unit-root statistic with a constant and its p-value; the lag length has the lowest AIC over common rows.

    NULL for a series too short or too regular for the regression.
    """
    def one(values: np.ndarray) -> dict:
        n = len(values)
        most = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)
        try:
            best = min(range(most + 1), key=lambda k: _unit_root_fit(values, k, most)[0])
            _, statistic, rows = _unit_root_fit(values, best, best)
            p_value = unit_root_p_value(float(statistic))
            found = float(statistic), best, rows, p_value, p_value < 0.05
        except (ValueError, np.linalg.LinAlgError):
            found = None, None, None, None, None
        names = ("statistic", "lags", "rows", "p_value", "stationary")
        return {k: [v] for k, v in zip(names, found)} | {f"critical_{k[:-1]}": [v] for k, v in ADF_CRITICAL.items()}

    critical = [f"critical_{k[:-1]}" for k in ADF_CRITICAL]
    return series_of(
        totals, kinds, one, "statistic double, lags int, rows int, p_value double, stationary boolean, " + ", ".join(f"{c} double" for c in critical)
    ).select("statistic", "lags", "rows", *critical, "p_value", "stationary", "series")


def outliers(totals: DataFrame, z_limit: float = 3.0, iqr_times: float = 1.5) -> DataFrame:
    """Every day with its z score, deviation from the mean, and both outlier marks."""
    q = F.col("Quantity_Sold")
    stats = totals.agg(
        F.avg(q).alias("mean"), F.stddev_pop(q).alias("std"),
        F.percentile(q, F.lit(0.25)).alias("q1"), F.percentile(q, F.lit(0.75)).alias("q3"),
    ).select(F.struct("*").alias("s")).scalar()
    marked = totals.withColumn("s", stats)
    spread = F.col("s.q3") - F.col("s.q1")
    return marked.select(
        "Date", "Quantity_Sold",
        safe_ratio(q - F.col("s.mean"), F.col("s.std")).alias("z_score"),
        (q - F.col("s.mean")).alias("deviation_from_mean"),
        (F.abs(safe_ratio(q - F.col("s.mean"), F.col("s.std"))) > z_limit).alias("is_z_outlier"),
        ((q < F.col("s.q1") - iqr_times * spread) | (q > F.col("s.q3") + iqr_times * spread)).alias("is_iqr_outlier"),
    )


def subseries(totals: DataFrame) -> DataFrame:
    """Totals by month and day of month."""
    return totals.groupBy(F.month("Date").alias("month"), F.dayofmonth("Date").alias("day")).agg(
        F.avg("Quantity_Sold").alias("mean_quantity"), F.count(F.lit(1)).alias("days")
    )


def eda_flags(totals: DataFrame) -> DataFrame:
    """Verdicts: trend direction, weekly seasonality, share of outlier days."""
    weekday = totals.groupBy(F.weekday("Date").alias("d")).agg(F.avg("Quantity_Sold").alias("m"))
    weekly = weekday.agg((F.stddev_samp("m") > F.avg("m") * 0.1).alias("w")).scalar()
    marks = outliers(totals).agg(
        F.count_if("is_iqr_outlier").alias("n"),
        (F.lit(100.0) * F.avg(F.col("is_iqr_outlier").cast("double"))).alias("pct"),
    ).select(F.struct("*").alias("m")).scalar()
    return linear_trend(totals).select(
        F.col("direction").alias("trend"),
        F.when(weekly, "Present").otherwise("Weak").alias("weekly_seasonality"),
        marks.alias("_m"),
    ).select("trend", "weekly_seasonality", F.col("_m.n").alias("outlier_days"), F.col("_m.pct").alias("outlier_pct"))


def item_correlation(daily: DataFrame, n: int = 100) -> DataFrame:
    """Correlation of the daily quantities of the ``n`` best sellers, missing days as 0.

    Days without a sale add nothing to the products, so only the sold pairs of a day meet; at most
    ``n`` items, and so n(n-1)/2 pairs, share a day.
    """
    best = daily.groupBy("Item").agg(F.sum("Quantity_Sold").alias("v")).orderBy(F.desc("v"), "Item").limit(n)
    kept = daily.join(best, "Item", "left_semi")
    days = kept.agg(F.count_distinct("Date").cast("double")).scalar()
    one = kept.groupBy("Item").agg(
        F.sum("Quantity_Sold").alias("s"), F.sum(F.col("Quantity_Sold") * F.col("Quantity_Sold")).alias("ss")
    )
    a = kept.select("Date", F.col("Item").alias("item_a"), F.col("Quantity_Sold").alias("qa"))
    b = kept.select("Date", F.col("Item").alias("item_b"), F.col("Quantity_Sold").alias("qb"))
    products = a.join(b, "Date").where(F.col("item_a") < F.col("item_b")).groupBy("item_a", "item_b").agg(
        F.sum(F.col("qa") * F.col("qb")).alias("sab")
    )
    left = one.select(F.col("Item").alias("item_a"), F.col("s").alias("sa"), F.col("ss").alias("ssa"))
    right = one.select(F.col("Item").alias("item_b"), F.col("s").alias("sb"), F.col("ss").alias("ssb"))
    # At most n rows a side: every pair, also those that never share a day.
    pairs = left.join(right, F.col("item_a") < F.col("item_b"))
    joined = pairs.join(products, ["item_a", "item_b"], "left").withColumn("_n", days)
    cov = F.coalesce("sab", F.lit(0.0)) - F.col("sa") * F.col("sb") / F.col("_n")
    spread = F.sqrt((F.col("ssa") - F.col("sa") * F.col("sa") / F.col("_n"))
                    * (F.col("ssb") - F.col("sb") * F.col("sb") / F.col("_n")))
    return joined.select("item_a", "item_b", safe_ratio(cov, spread).alias("correlation"))

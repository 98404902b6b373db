"""Series statistics against numpy."""

import datetime as dt

import numpy as np
import pytest

from demandloom.operators import stats
from helpers import D, rows


LEVELS = ("levels",)


def totals(spark, values):
    return spark.createDataFrame(
        [(D(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "Date date, Quantity_Sold double")


@pytest.fixture(scope="module")
def wave():
    rng = np.random.default_rng(4)
    return 50 + 10 * np.sin(np.arange(200) * 2 * np.pi / 7) + rng.normal(size=200).cumsum() * 0.3 + rng.normal(size=200)


def test_autocorrelations(spark, wave):
    df = totals(spark, wave)
    pairwise = {r["lag"]: r["correlation"] for r in stats.autocorrelation(df, 10).collect()}
    c = wave - wave.mean()
    function = {r["lag"]: r["acf"] for r in stats.acf(df, 10, LEVELS).collect()}
    for k in range(1, 11):
        assert pairwise[k] == pytest.approx(np.corrcoef(wave[k:], wave[:-k])[0, 1])
        assert function[k] == pytest.approx((c[k:] * c[:-k]).sum() / (c * c).sum())
    assert function[0] == 1.0


def test_partial_autocorrelation_solves_yule_walker(spark, wave):
    n, c = len(wave), wave - wave.mean()
    gamma = [(c[k:] * c[: n - k]).sum() / (n - k) for k in range(11)]
    rho = np.array(gamma) / gamma[0]
    found = [r["pacf"] for r in stats.pacf(totals(spark, wave), 10, LEVELS).orderBy("lag").collect()]
    for k in range(1, 11):
        system = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert found[k] == pytest.approx(np.linalg.solve(system, rho[1: k + 1])[-1], abs=1e-9)


def test_adf_is_the_regression_t_value(spark, wave):
    row = stats.adf(totals(spark, wave), LEVELS).first()
    dy, lags = np.diff(wave), row["lags"]
    y1 = wave[:-1]
    x = np.column_stack([np.ones(len(dy) - lags), y1[lags:]] + [dy[lags - k: len(dy) - k] for k in range(1, lags + 1)])
    target = dy[lags:]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    resid = target - x @ beta
    cov = resid @ resid / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)
    assert row["statistic"] == pytest.approx(beta[1] / np.sqrt(cov[1, 1]), rel=1e-6) and row["rows"] == len(target)
    walk = np.random.default_rng(0).normal(size=300).cumsum()
    assert not stats.adf(totals(spark, walk), LEVELS).first()["stationary"]
    assert stats.adf(totals(spark, np.random.default_rng(0).normal(size=300)), LEVELS).first()["stationary"]


def test_unit_root_p_values():
    """Published critical values have their probability."""
    for level, value in stats.ADF_CRITICAL.items():
        assert stats.unit_root_p_value(value) == pytest.approx(float(level[:-1]) / 100, abs=0.002)
    assert stats.unit_root_p_value(3.0) == 1.0 and stats.unit_root_p_value(-20.0) == 0.0


def test_kpss_tells_trend_from_noise(spark):
    rng = np.random.default_rng(8)
    noise, trend = rng.normal(size=250), np.arange(250) * 0.5 + rng.normal(size=250)
    assert stats.kpss(totals(spark, noise), LEVELS).first()["stationary"]
    rising = stats.kpss(totals(spark, trend), LEVELS).first()
    assert not rising["stationary"] and rising["p_value"] == 0.01


def test_decomposition_adds_up(spark, wave):
    got = stats.seasonal_decompose(totals(spark, wave)).orderBy("Date").collect()
    middle = np.convolve(wave, np.ones(7) / 7, "valid")
    slope, start = np.polyfit(np.arange(7), middle[:7], 1)
    assert [r["trend"] for r in got[:3]] == pytest.approx([start + slope * x for x in (-3, -2, -1)])
    slope, start = np.polyfit(np.arange(7), middle[-7:], 1)
    assert [r["trend"] for r in got[-3:]] == pytest.approx([start + slope * x for x in (7, 8, 9)])
    assert sum(r["seasonal"] for r in got[:7]) == pytest.approx(0.0, abs=1e-9)
    for r in got:
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["Quantity_Sold"])


def test_trend_outliers_flags(spark, wave):
    line = stats.linear_trend(totals(spark, wave)).first()
    slope, intercept = np.polyfit(np.arange(len(wave)), wave, 1)
    assert line["slope"] == pytest.approx(slope) and line["intercept"] == pytest.approx(intercept)
    assert 0.0 <= line["p_value"] <= 1.0
    spiky = np.r_[np.full(60, 10.0) + np.arange(60) % 3, 500.0]
    marked = stats.outliers(totals(spark, spiky)).where("is_z_outlier and is_iqr_outlier").collect()
    assert len(marked) == 1 and marked[0]["deviation_from_mean"] == pytest.approx(500 - spiky.mean())
    flags = stats.eda_flags(totals(spark, spiky)).first()
    assert flags["outlier_days"] == 1 and flags["trend"] == "Increasing"


def student_tail_by_area(t, v):
    """Two-sided tail by Simpson's rule over the angle."""
    import math
    top = math.atan(t / math.sqrt(v))
    grid = np.linspace(0, top, 200_001)
    f = np.cos(grid) ** (v - 1)
    area = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * top / 200_000 / 3
    return 1 - 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * area


def test_student_tail(spark):
    """Known quantiles (t table) to their digits, the area to 1e-8, edges."""
    table = [(12.706205, 1, 0.05), (4.302653, 2, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (3.169273, 10, 0.01), (2.042272, 30, 0.05)]
    cases = [(t, v) for t, v, _ in table] + [(t, v) for t in (0.0, 0.01, 0.5, 1.0, 2.5, 6.0) for v in (1, 2, 3, 7, 40, 300, 2400)] + [(3.0, 0), (None, 5), (float("inf"), 4)]
    frame = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "i int, t double, v int")
    found = {(r["t"], r["v"]): r["p"] for r in frame.select("t", "v", stats.student_tail(stats.F.col("t"), stats.F.col("v")).alias("p")).collect()}
    assert [found[t, v] for t, v, _ in table] == pytest.approx([p for *_, p in table], abs=1e-7)
    assert found[3.0, 0] is None and found[None, 5] is None and found[float("inf"), 4] == 0.0
    for (t, v), p in found.items():
        if t is not None and v and np.isfinite(t):
            assert p == pytest.approx(student_tail_by_area(t, v), abs=1e-8), (t, v)


def test_constant_and_short_series(spark):
    """A constant series has no correlations; a series of three days no regression."""
    flat = totals(spark, [5.0] * 40)
    assert [r["acf"] for r in stats.acf(flat, 2, LEVELS).collect()] == [None] * 3
    assert stats.kpss(flat, LEVELS).first()["statistic"] is None and stats.adf(totals(spark, [1, 2, 1]), LEVELS).first()["statistic"] is None


def test_levels_and_differences_come_from_one_job(spark, wave):
    df = totals(spark, wave)
    both = {r["series"]: r for r in stats.kpss(df).collect()}
    assert both["levels"] == stats.kpss(df, LEVELS).first()
    assert both["differences"]["statistic"] == pytest.approx(stats.kpss(totals(spark, np.diff(wave)), LEVELS).first()["statistic"])


def test_moving_average_waits_for_full_window(spark):
    got = rows(stats.moving_averages(totals(spark, range(10)), (3,)), "Date")
    assert [r[2] for r in got] == [None, None] + [float(i) for i in range(1, 9)]


def test_item_correlation_counts_missing_as_zero(spark):
    data = {"a": [1, 2, 0, 4, 5], "b": [2, 0, 0, 1, 7], "c": [0, 0, 3, 0, 0]}
    frame = spark.createDataFrame(
        [(D(2025, 1, 1 + i), k, float(v)) for k, q in data.items() for i, v in enumerate(q) if v],
        "Date date, Item string, Quantity_Sold double")
    got = {(r["item_a"], r["item_b"]): r["correlation"] for r in stats.item_correlation(frame).collect()}
    expected = {(a, b): np.corrcoef(data[a], data[b])[0, 1] for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}
    assert len(stats.item_correlation(frame, 2).collect()) == 1

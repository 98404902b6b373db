"""Models fitted per item series.

Fitting sees one item's series at a time (at most one row per period) and returns one row of
parameters. Scoring joins those rows back and runs as ordinary column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.session import spread

# Weight of the squared coefficients in the item regressions.
RIDGE = 15.0

# --- regression on the feature frame ---------------------------------------------------------


def ridge(x: np.ndarray, y: np.ndarray, weight: float = RIDGE) -> tuple[float, np.ndarray]:
    """Ridge on standardised columns; returns the intercept and coefficients of the raw columns."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = (x - centre) / scale
    gram = z.T @ z + weight * np.eye(x.shape[1])
    coef = np.linalg.solve(gram, z.T @ (y - y.mean())) / scale
    return float(y.mean() - coef @ centre), coef


def fit_item_regressions(train: DataFrame, columns: Sequence[str], minimum: int, keys: Sequence[str] = ("Item",)) -> DataFrame:
    """keys, intercept, coefficients for every series of at least ``minimum`` rows."""
    names, keys = list(columns), list(keys)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[:1][keys]
        if len(frame) < minimum:
            return head.iloc[:0].assign(intercept=pd.Series(dtype=float), coefficients=pd.Series(dtype=object))
        x = frame[names].to_numpy(dtype=float)
        intercept, coef = ridge(x, frame["Quantity_Sold"].to_numpy(dtype=float))
        return head.assign(intercept=intercept, coefficients=[coef.tolist()])

    kinds = dict(train.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return (
        spread(train.select(*dict.fromkeys([*keys, "Quantity_Sold", *names])), *keys)
        .groupBy(*keys)
        .applyInPandas(fit, f"{schema}, intercept double, coefficients array<double>")
    )


def score_item_regressions(rows: DataFrame, models: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("Item",)) -> DataFrame:
    """Rows with ``item_pred``, NULL where the series has no model of its own."""
    value: Column = F.col("intercept")
    for place, name in enumerate(columns):
        value = value + F.col("coefficients")[place] * F.col(name)
    return (
        rows.join(models, list(keys), "left").withColumn("item_pred", value).drop("intercept", "coefficients")
    )


# --- ARIMA(1,1,1) ----------------------------------------------------------------------------


def css_arima(y: np.ndarray) -> tuple[float, float, float]:
    """phi, theta and the next step by conditional sum of squares, on a grid refined four times."""
    d = np.diff(y)
    best, width = (0.0, 0.0), 0.98
    for _ in range(5):
        axis = [np.clip(np.linspace(c - width, c + width, 15), -0.98, 0.98) for c in best]
        phi, theta = (g.ravel() for g in np.meshgrid(*axis))
        error, total = np.zeros(phi.size), np.zeros(phi.size)
        for before, now in zip(d[:-1], d[1:]):
            error = now - phi * before - theta * error
            total += error * error
        pick = int(total.argmin())
        best, last_error = (phi[pick], theta[pick]), error[pick]
        width /= 5.0
    return best[0], best[1], best[0] * d[-1] + best[1] * last_error


def fit_arima(train: DataFrame, minimum: int) -> DataFrame:
    """Item, last_date, last_value, phi, theta, next_step; a fit that breaks down gives no row."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("Date")
        y = frame["Quantity_Sold"].to_numpy(dtype=float)
        names = ["Item", "last_date", "last_value", "phi", "theta", "next_step"]
        if len(y) < max(minimum, 4):
            return pd.DataFrame(columns=names)
        phi, theta, step = css_arima(y)
        if not math.isfinite(step):
            return pd.DataFrame(columns=names)
        row = (frame["Item"].iloc[0], frame["Date"].iloc[-1], y[-1], phi, theta, step)
        return pd.DataFrame([row], columns=names)

    return spread(train.select("Item", "Date", "Quantity_Sold"), "Item").groupBy("Item").applyInPandas(
        fit, "Item string, last_date date, last_value double, phi double, theta double, next_step double")


def score_arima(rows: DataFrame, models: DataFrame, step_days: int) -> DataFrame:
    """Rows with ``item_pred``: the last value plus the geometric sum of the fading steps."""
    ahead = F.date_diff("Date", "last_date") / F.lit(float(step_days))
    travelled = (F.lit(1.0) - F.pow("phi", ahead)) / (F.lit(1.0) - F.col("phi"))
    scored = rows.join(models, "Item", "left").withColumn(
        "item_pred", F.col("last_value") + F.col("next_step") * travelled)
    return scored.drop("last_date", "last_value", "phi", "theta", "next_step")


# --- additive trend and seasons --------------------------------------------------------------

CHANGEPOINTS, YEARLY, WEEKLY = 25, 10, 3
# Prior scales: changes of slope are held tight, seasons loose.
CHANGE_SCALE, SEASON_SCALE = 0.05, 10.0


def _change_places() -> list[float]:
    """Evenly spread over the first four fifths of the history."""
    return [0.8 * (k + 1) / (CHANGEPOINTS + 1) for k in range(CHANGEPOINTS)]


def additive_terms(day: Column, origin: Column, span: Column) -> list[Column]:
    """The design columns of one date: line, hinges, yearly and weekly waves."""
    t = F.date_diff(day, origin) / span
    terms = [F.lit(1.0), t] + [F.greatest(F.lit(0.0), t - F.lit(c)) for c in _change_places()]
    number = F.unix_date(day).cast("double")
    for period, order in ((365.25, YEARLY), (7.0, WEEKLY)):
        for k in range(1, order + 1):
            angle = number * F.lit(2.0 * math.pi * k / period)
            terms += [F.sin(angle), F.cos(angle)]
    return terms


def fit_additive(train: DataFrame, minimum: int) -> DataFrame:
    """Item, origin, span, scale, weights of every series of at least ``minimum`` rows."""
    bounds = train.groupBy("Item").agg(
        F.min("Date").alias("origin"),
        F.greatest(F.date_diff(F.max("Date"), F.min("Date")), F.lit(1)).cast("double").alias("span"),
        F.count(F.lit(1)).alias("rows"),
        F.greatest(F.max(F.abs("Quantity_Sold")), F.lit(1.0)).alias("scale"),
    )
    joined = train.select("Item", "Date", "Quantity_Sold").join(bounds.where(F.col("rows") >= minimum), "Item")
    design = joined.select(
        "Item", "origin", "span", "scale", (F.col("Quantity_Sold") / F.col("scale")).alias("y"),
        F.array(*additive_terms(F.col("Date"), F.col("origin"), F.col("span"))).alias("x"))
    prior = np.array([1e-4, 1e-4] + [1.0 / CHANGE_SCALE] * CHANGEPOINTS + [1.0 / SEASON_SCALE] * 2 * (YEARLY + WEEKLY))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(frame["x"].to_list()), frame["y"].to_numpy(dtype=float)
        weights = np.linalg.solve(x.T @ x + np.diag(prior), x.T @ y)
        return frame.iloc[:1][["Item", "origin", "span", "scale"]].assign(weights=[weights.tolist()])

    return spread(design, "Item").groupBy("Item").applyInPandas(
        fit, "Item string, origin date, span double, scale double, weights array<double>")


def score_additive(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with ``item_pred``."""
    joined = rows.join(models, "Item", "left")
    value: Column = F.lit(0.0)
    for place, term in enumerate(additive_terms(F.col("Date"), F.col("origin"), F.col("span"))):
        value = value + F.col("weights")[place] * term
    return joined.withColumn("item_pred", value * F.col("scale")).drop("origin", "span", "scale", "weights")

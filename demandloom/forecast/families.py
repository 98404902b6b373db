"""The forecaster families behind one interface: train, predict, evaluate, save and load."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.forecast import perseries, pooled, recursive, trees
from demandloom.forecast.pooled import Linear, PooledSettings
from demandloom.forecast.state import StatePlan
from demandloom.forecast.trees import Trees
from demandloom.functions.dates import TradingCalendar
from demandloom.functions.numeric import half_even
from demandloom.operators import features as feats
from demandloom.operators import metrics
from demandloom.operators.series import future_grid, item_codes, step_days
from demandloom.session import materialise

BLEND = 0.15
# Fewest training rows for a model of an item's own.
MIN_ROWS = {"daily": 180, "weekly": 100}
MIN_ROWS_ARIMA = {"daily": 180, "weekly": 200}
FAMILIES = ("boosted", "forest", "arima", "additive")
POOLED = ("boosted", "forest", "linear", "tweedie")
# Families whose item models refit the leaves of the pooled trees, with the penalties of an item's leaf.
ITEM_PENALTIES = {"boosted": (trees.ITEM_L1, trees.ITEM_L2), "forest": (0.0, 5.0)}


_METADATA = "family string, frequency string, columns array<string>, first_date string, last_date string"


@dataclass(frozen=True)
class Bundle:
    """A trained family: the pooled model (if any) and tables of item parameters.

    The items with a model of their own are the rows of ``item_models``.
    """

    family: str
    frequency: str
    columns: tuple[str, ...]
    factors: DataFrame
    mean: DataFrame
    item_models: DataFrame
    pooled: PipelineModel | Trees | Linear | None = field(default=None)
    # The first and last date of the training rows.
    first_date: str | None = None
    last_date: str | None = None

    def save(self, folder: str) -> None:
        spark = self.factors.sparkSession
        if isinstance(self.pooled, Trees):
            self.pooled.write(spark, f"{folder}/pooled")
        elif self.pooled is not None:
            self.pooled.write().overwrite().save(f"{folder}/pooled")
        for name in ("factors", "mean", "item_models"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        spark.createDataFrame(
            [(self.family, self.frequency, list(self.columns), self.first_date, self.last_date)], _METADATA,
        ).write.mode("overwrite").json(f"{folder}/metadata")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Bundle:
        meta = spark.read.schema(_METADATA).json(f"{folder}/metadata").first()
        if meta["family"] == "boosted":
            model = Trees.read(spark, f"{folder}/pooled", meta["columns"])
        else:
            model = PipelineModel.load(f"{folder}/pooled") if meta["family"] in POOLED else None
        return Bundle(
            family=meta["family"], frequency=meta["frequency"], columns=tuple(meta["columns"]),
            first_date=meta["first_date"], last_date=meta["last_date"],
            **{name: spark.read.parquet(f"{folder}/{name}") for name in ("factors", "mean", "item_models")},
            pooled=model,
        )


without_leaks = feats.known_before


def train(frame: DataFrame, family: str, frequency: str = "weekly", settings: PooledSettings = PooledSettings()) -> Bundle:
    """Fit a family on a (materialised) feature frame."""
    ready = materialise(without_leaks(frame)) if family in POOLED else frame
    return _train_ready(ready, family, frequency, settings)


def _train_ready(ready: DataFrame, family: str, frequency: str, settings: PooledSettings) -> Bundle:
    columns = tuple(feats.feature_columns(frequency))
    model = None
    if family in POOLED:
        model = pooled.fit_pooled(ready, columns, family, settings)
        own = fit_own(ready, model, family, columns, MIN_ROWS[frequency])
    elif family == "arima":
        own = perseries.fit_arima(ready, MIN_ROWS_ARIMA[frequency])
    elif family == "additive":
        own = perseries.fit_additive(ready, MIN_ROWS[frequency])
    else:
        raise ValueError(f"family must be one of {FAMILIES}")
    own = materialise(own)
    extent = ready.agg(F.min("Date").cast("string"), F.max("Date").cast("string")).first()
    return Bundle(
        family=family, frequency=frequency, columns=columns, first_date=extent[0], last_date=extent[1],
        factors=feats.weekday_factors(ready),
        mean=ready.agg(F.coalesce(F.avg("Quantity_Sold"), F.lit(0.0)).alias("mean")),
        item_models=own, pooled=model,
    )


def fit_own(ready: DataFrame, model: PipelineModel | Trees, family: str, columns: Sequence[str], minimum: int) -> DataFrame:
    """Models of the family's own kind for the items of at least ``minimum`` rows."""
    if family in ITEM_PENALTIES:
        return trees.fit_item_leaves(ready, pooled.as_numbers(model, columns), minimum, *ITEM_PENALTIES[family])
    return perseries.fit_item_regressions(ready, columns, minimum)


def score_both(rows: DataFrame, model: PipelineModel | Trees, own: DataFrame, family: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``pooled_pred`` and ``item_pred``."""
    if family in ITEM_PENALTIES:
        return trees.score_item_leaves(rows, own, pooled.as_numbers(model, columns))
    return perseries.score_item_regressions(pooled.score_pooled(model, rows), own, columns)


def predict(frame: DataFrame, bundle: Bundle, leak_free: bool = False) -> DataFrame:
    """Item, Date, Quantity_Sold, Raw_Pred, DOW, dow_factor, Predicted.

    ``leak_free`` says the differences of ``frame`` are shifted already.
    """
    if bundle.pooled is not None:
        ready = (frame if leak_free else without_leaks(frame)).select("Item", "Date", "Quantity_Sold", *bundle.columns)
        scored = score_both(ready, bundle.pooled, bundle.item_models, bundle.family, bundle.columns)
        raw = F.when(
            F.col("item_pred").isNotNull(), BLEND * F.col("item_pred") + (1 - BLEND) * F.col("pooled_pred")
        ).otherwise(F.col("pooled_pred"))
    else:
        if bundle.family == "arima":
            scored = perseries.score_arima(frame, bundle.item_models, step_days(bundle.frequency))
        else:
            scored = perseries.score_additive(frame, bundle.item_models)
        raw = F.coalesce("item_pred", bundle.mean.scalar())
    kept = scored.select("Item", "Date", "Quantity_Sold", raw.alias("Raw_Pred"))
    return feats.apply_weekday_factors(kept, bundle.factors).select(
        "Item", "Date", "Quantity_Sold", "Raw_Pred", "DOW", "dow_factor", "Predicted")


def train_and_predict(
    frame: DataFrame, family: str, frequency: str = "weekly", periods: int = 12,
    settings: PooledSettings = PooledSettings(),
) -> DataFrame:
    """Train before the hold-out and forecast it."""
    ready, is_test = _split(frame, family, periods)
    bundle = _train_ready(ready.where(~is_test), family, frequency, settings)
    return predict(ready.where(is_test), bundle, leak_free=True)


def _split(frame: DataFrame, family: str, periods: int) -> tuple[DataFrame, Column]:
    """The frame free of leaks, and the test of its hold-out rows (from the last date backwards)."""
    ready = materialise(without_leaks(frame) if family in POOLED else frame)
    return ready, F.col("Date") >= F.date_sub(ready.agg(F.max("Date")).scalar(), periods * 7)


def overfit_check(frame: DataFrame, family: str = "boosted", frequency: str = "weekly", periods: int = 12,
                  settings: PooledSettings = PooledSettings()) -> DataFrame:
    """Train and test metrics of one family with their gap and verdict."""
    ready, is_test = _split(frame, family, periods)
    bundle = _train_ready(ready.where(~is_test), family, frequency, settings)
    scored = predict(ready, bundle, leak_free=True)
    return metrics.overfit_check(scored.withColumn("split", F.when(is_test, "test").otherwise("train")))


COMPARED = ("r2", "wmape", "mae", "median_period_accuracy", "periods_within_20pct", "periods_within_50pct")


def compare(frame: DataFrame, families: Sequence[str] = FAMILIES, frequency: str = "weekly",
            settings: PooledSettings = PooledSettings()) -> tuple[DataFrame, DataFrame]:
    """Hold-out metrics of each family, and the seconds that each took. A family that can't be fitted raises."""
    spark = frame.sparkSession
    rows, seconds = [], []
    for family in families:
        start = time.time()
        found = metrics.forecast_metrics(train_and_predict(frame, family, frequency, settings=settings)).first()
        rows.append((family, *[None if found[n] is None else float(found[n]) for n in COMPARED]))
        seconds.append((family, round(time.time() - start, 1)))
    return (
        spark.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in COMPARED)),
        spark.createDataFrame(seconds, "model string, time_sec double"))


def generate_forecast(series: DataFrame, bundle: Bundle, weeks: int = 12, calendar: TradingCalendar = TradingCalendar(),
                      codes: DataFrame | None = None) -> DataFrame:
    """Forecast of the weeks after the last date, from a trained family.

    A pooled family goes one period at a time inside each item: a forecast is history for the next one's lags, windows
    and differences, so no period is computed from quantities that nobody expects. All items are one job.
    """
    periods = weeks * (7 if bundle.frequency == "daily" else 1)
    if bundle.pooled is None:
        return predict(future_grid(series, periods, bundle.frequency), bundle)
    model, log = pooled.as_numbers(bundle.pooled, bundle.columns), bundle.family in ITEM_PENALTIES
    parameters = bundle.item_models.columns[1:]

    def responder(facts: dict, values: np.ndarray):
        def own(x: np.ndarray) -> float:
            if log:
                added = np.asarray(facts["added"], float).reshape(model.value.shape)
                return float(model.respond(model.raw(model.leaves(x), added))[0])
            return float(facts["intercept"] + x[0] @ np.asarray(facts["coefficients"], float))

        def respond(x: np.ndarray, day) -> tuple[float, float]:
            raw = float(model.predict(x)[0])
            if facts[parameters[-1]] is not None:
                raw = BLEND * own(x) + (1 - BLEND) * raw
            raw = max(0.0, raw)
            return raw, max(0.0, float(np.round(raw * facts[f"dow_{day.weekday()}"])))

        return respond

    plan = feats.PLANS[bundle.frequency]
    codes = item_codes(series) if codes is None else codes
    facts = codes.join(feats.weekday_factor_matrix(bundle.factors), "Item", "left").na.fill(
        1.0, [f"dow_{d}" for d in range(7)]).join(bundle.item_models, "Item", "left")
    walked = recursive.walk(
        series, facts, periods, bundle.frequency, bundle.columns, calendar,
        StatePlan.of(bundle.columns, calendar.event_date, trend=(plan.short, plan.long, 10.0)), responder)
    return walked.select(
        "Item", "Date", F.lit(0.0).alias("Quantity_Sold"), "Raw_Pred", F.weekday("Date").alias("DOW"), "Predicted")


# --- rolling-origin cross-validation ---------------------------------------------------------


def cv_rows(frame: DataFrame, folds: Sequence[tuple[str, str]]) -> DataFrame:
    """Every row with each fold it belongs to; ``is_test`` inside the fold's dates, else before them."""
    marks = F.array(*[
        F.struct(
            F.lit(number).alias("fold"),
            F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("is_test"),
            (F.col("Date") <= F.lit(end).cast("date")).alias("inside"),
        )
        for number, (start, end) in enumerate(folds, 1)
    ])
    return (
        frame.withColumn("_m", F.explode(marks)).where(F.col("_m.inside"))
        .withColumns({"fold": F.col("_m.fold"), "is_test": F.col("_m.is_test")}).drop("_m")
    )


def cross_validate(frame: DataFrame, folds: Sequence[tuple[str, str]], columns: Sequence[str], kind: str = "boosted",
                   minimum: int = 20, settings: PooledSettings = PooledSettings()) -> DataFrame:
    """Forecast rows of every fold: own model where the item has ``minimum`` rows, else pooled.

    ``frame`` is one frame for all folds, or has the columns fold and is_test and rows of its own for each fold.
    Forecasts lie between 0 and twice the item's training maximum (100 without training rows), in whole units.
    """
    rows = frame if "fold" in frame.columns else cv_rows(frame, folds)
    rows = materialise(rows.select("fold", "is_test", "Item", "Date", "Quantity_Sold", *columns))
    past, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))
    peaks = past.groupBy("fold", "Item").agg(F.max("Quantity_Sold").alias("peak"))
    parts = []
    for number in range(1, len(folds) + 1):
        own_past = past.where(F.col("fold") == number)
        model = pooled.fit_pooled(own_past, columns, kind, settings)
        own = fit_own(own_past, model, kind, columns, minimum)
        parts.append(score_both(test.where(F.col("fold") == number), model, own, kind, columns).select(
            "fold", "Item", "Date", "Quantity_Sold", "pooled_pred", "item_pred"))
    blended = reduce(DataFrame.unionByName, parts).join(peaks, ["fold", "Item"], "left")
    value = F.coalesce("item_pred", "pooled_pred", F.lit(0.0))
    cap = 2.0 * F.coalesce("peak", F.lit(100.0))
    return blended.select(
        "fold", "Item", "Date", "Quantity_Sold",
        half_even(F.least(F.greatest(value, F.lit(0.0)), cap)).alias("Predicted"))


def cv_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics per fold over the rows with a positive actual."""
    valid = predictions.where(
        F.col("Quantity_Sold").isNotNull() & F.col("Predicted").isNotNull()
        & (F.col("Quantity_Sold") > 0) & (F.col("Predicted") >= 0))
    y, p = F.col("Quantity_Sold"), F.col("Predicted")
    return valid.groupBy("fold").agg(
        metrics.r_squared(y, p).alias("r2"), metrics.wmape(y, p).alias("wmape"),
        metrics.mae(y, p).alias("mae"), F.count(F.lit(1)).alias("valid_predictions"))

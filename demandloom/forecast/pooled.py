"""Tree and linear models pooled over all items, trained by MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GeneralizedLinearRegression, GeneralizedLinearRegressionModel, LinearRegression, RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.forecast import boosting, trees
from demandloom.forecast.trees import Trees


@dataclass(frozen=True)
class PooledSettings:
    """Sizes of the pooled learners.

    ``rounds`` are the most trees that boosting takes; it ends at the best validation error.
    """

    rounds: int = 300
    # Trees that one round of boosting fits side by side.
    parallel: int = 15
    step: float = 0.015
    boosted_depth: int = 3
    boosted_min_rows: int = 15
    sample: float = 0.6
    # Penalties of a boosted leaf: a sum of gradients below the first counts nothing, the second shrinks the step.
    l1: float = 5.0
    l2: float = 10.0
    trees: int = 300
    forest_depth: int = 4
    forest_min_rows: int = 5
    validation_share: float = 0.15
    # Trees without a better validation error that end boosting.
    patience: int = 15
    seed: int = 42


def _learner(kind: str, settings: PooledSettings):
    common = {"featuresCol": "features", "labelCol": "Quantity_Sold", "predictionCol": "pooled_pred"}
    if kind == "forest":
        return RandomForestRegressor(
            **common, numTrees=settings.trees, maxDepth=settings.forest_depth,
            minInstancesPerNode=settings.forest_min_rows, seed=settings.seed,
        )
    if kind == "linear":
        return LinearRegression(**common, regParam=1.0, elasticNetParam=0.0)
    if kind == "tweedie":
        return GeneralizedLinearRegression(
            **common, family="tweedie", variancePower=1.5, linkPower=0.0, regParam=1.0, maxIter=25)
    raise ValueError(f"unknown pooled learner: {kind}")


def mark_validation(train: DataFrame, share: float) -> DataFrame:
    """The last ``share`` of each item's rows, by date, steer early stopping."""
    item = Window.partitionBy("Item")
    place = F.row_number().over(item.orderBy("Date"))
    return train.withColumn("is_val", place > F.count(F.lit(1)).over(item) * F.lit(1.0 - share))


@dataclass(frozen=True)
class Linear:
    """A linear model as numbers; with ``log_link`` its exponential."""

    intercept: float
    coefficients: np.ndarray
    log_link: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.intercept + x @ self.coefficients
        return np.exp(raw) if self.log_link else raw


def fit_pooled(train: DataFrame, columns: Sequence[str], kind: str, settings: PooledSettings) -> PipelineModel | Trees:
    if kind == "boosted":
        return boosting.fit(mark_validation(train, settings.validation_share), columns, settings)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return Pipeline(stages=[assembler, _learner(kind, settings)]).fit(train)


def as_numbers(model: PipelineModel | Trees | Linear, columns: Sequence[str]) -> Trees | Linear:
    """The model as arrays that a task can hold."""
    if not isinstance(model, PipelineModel):
        return model
    fitted = model.stages[-1]
    if isinstance(fitted, RandomForestRegressionModel):
        feature, threshold, value = trees.parsed(fitted.toDebugString, fitted.getMaxDepth())
        return Trees(tuple(columns), feature, threshold, value / len(value))
    return Linear(float(fitted.intercept), np.asarray(fitted.coefficients.toArray()), isinstance(fitted, GeneralizedLinearRegressionModel))


def score_pooled(model: PipelineModel | Trees, rows: DataFrame) -> DataFrame:
    """Rows with ``pooled_pred``."""
    if isinstance(model, Trees):
        return trees.score(rows, model)
    return model.transform(rows).drop("features")

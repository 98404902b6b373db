"""Boosted trees under the Tweedie deviance with a log link, pooled over all items.

Newton boosting: with power p and raw score m, a row's loss is y*exp((1-p)m)/(p-1) + exp((2-p)m)/(2-p). Its first
and second derivatives g and h make the working response -g/h with weight h, to which MLlib fits the weighted trees of
a round: ``parallel`` of them in one fit, each on its own sample of rows and columns (one at a time gives plain
boosting, at the price of a fit for each tree). Leaf values are then Newton steps with the penalties of the settings,
from sums over all training rows. A round costs one fit, one pass that places the rows in the leaves and one aggregate
of a few rows; scores and leaves are checkpointed columns. Boosting ends once ``patience`` trees brought no lower
deviance on the held-out rows.

Negative quantities count as zero, which the deviance needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.forecast.trees import TWEEDIE_POWER, Trees, leaf_column, newton_step, parsed
from demandloom.session import materialise

def best_round(errors: Sequence[float], patience: int) -> int | None:
    """The round (from 1) after which ``patience`` rounds brought no lower error; None while still open."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            return best + 1
    return None


def loss_parts(power: float = TWEEDIE_POWER):
    """The two parts of the loss, without their constants, from columns ``y`` and ``raw``."""
    return (
        (F.col("y") * F.exp(F.lit(1 - power) * F.col("raw"))).alias("a"),
        F.exp(F.lit(2 - power) * F.col("raw")).alias("b"))


def fit(rows: DataFrame, columns: Sequence[str], settings, power: float = TWEEDIE_POWER) -> Trees:
    """Trees fitted on the rows outside ``is_val``, as many as the held rows want.

    ``rows`` has the feature columns, Quantity_Sold and is_val.
    """
    names = [f"x{i}" for i in range(len(columns))]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    plain = rows.select(
        *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)],
        F.greatest(F.col("Quantity_Sold").cast("double"), F.lit(0.0)).alias("y"), "is_val")
    state = materialise(assembler.transform(plain))
    counts = {r["is_val"]: r for r in state.groupBy("is_val").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).collect()}
    if False not in counts:
        raise ValueError("boosting needs training rows")
    held, depth = True in counts, settings.boosted_depth
    base = math.log(max(counts[False]["mean"], 1e-6))
    state = state.withColumn("raw", F.lit(base))
    a, b = loss_parts(power)
    found: list[tuple] = []
    # The held-out loss after each round, that of the base first.
    errors: list[float] = []
    patience = -(-settings.patience // settings.parallel)
    while True:
        ends = len(found) >= settings.rounds or held and best_round(errors, patience) is not None
        width = 0 if ends else min(settings.parallel, settings.rounds - len(found))
        work = state.select("*", a, b).withColumn("h", F.lit(power - 1) * F.col("a") + F.lit(2 - power) * F.col("b"))
        grown: list[tuple] = []
        if width:
            core = work.where(~F.col("is_val")).select("features", ((F.col("a") - F.col("b")) / F.col("h")).alias("z"), "h")
            learner = RandomForestRegressor(
                featuresCol="features", labelCol="z", weightCol="h", numTrees=width, bootstrap=False, subsamplingRate=settings.sample,
                featureSubsetStrategy=str(settings.sample), maxDepth=depth, minInstancesPerNode=settings.boosted_min_rows,
                seed=settings.seed + len(found))
            grown = list(zip(*parsed(learner.fit(core).toDebugString, depth)))
        elif not held or len(errors) > len(found) // settings.parallel:
            break
        placed = F.array(*[leaf_column(feature, threshold, names) for feature, threshold, _ in grown]).cast("array<int>")
        kept = materialise(work.drop("h").withColumn("leaves", placed))
        sums = kept.select("is_val", "a", "b", F.posexplode_outer("leaves").alias("tree", "leaf")).groupBy("is_val", "tree", "leaf").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
        # Every held-out row is in one leaf of the first tree.
        losses = [r["a"] / (power - 1) + r["b"] / (2 - power) for r in sums if r["is_val"] and not r["tree"]]
        errors.append(math.fsum(losses))
        if not width:
            break
        one, two = np.zeros((2, width, 1 << depth))
        for row in sums:
            if not row["is_val"]:
                one[row["tree"], row["leaf"]], two[row["tree"], row["leaf"]] = row["a"], row["b"]
        value = settings.step * newton_step(two - one, (power - 1) * one + (2 - power) * two, settings.l1, settings.l2)
        found += [(feature, threshold, v) for (feature, threshold, _), v in zip(grown, value)]
        added = reduce(add, [F.element_at(F.lit(v.tolist()), F.col("leaves")[t] + 1) for t, v in enumerate(value)])
        state = kept.withColumn("raw", F.col("raw") + added).drop("a", "b", "leaves")
    trees = Trees(tuple(columns), *(np.array([x[k] for x in found]) for k in range(3)), base=base, log_link=True)
    return trees.first(max(1, min(int(np.argmin(errors)) * settings.parallel, len(found)))) if held else trees


def deviance(rows: DataFrame, predicted: str = "Predicted", power: float = TWEEDIE_POWER) -> float:
    """Mean Tweedie deviance of positive predictions."""
    y, m = F.greatest(F.col("Quantity_Sold").cast("double"), F.lit(0.0)), F.col(predicted)
    unit = 2 * (
        F.pow(y, F.lit(2 - power)) / F.lit((1 - power) * (2 - power)) - y * F.pow(m, F.lit(1 - power)) / F.lit(1 - power)
        + F.pow(m, F.lit(2 - power)) / F.lit(2 - power))
    return rows.agg(F.avg(unit)).first()[0]

"""Fitted trees as arrays: scored in Arrow batches, walked one period at a time, refitted leaf by leaf.

A tree of depth d has 2**d - 1 inner places and 2**d leaves, numbered from the left; a branch that ends early goes
left to its first leaf. An ensemble is a few hundred kilobytes at most, whatever the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.session import spread

_LINE = re.compile(r"^(\s*)(?:(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+))$")
SCHEMA = "tree int, place int, feature int, threshold double, value double"
# A place without a split.
NO_SPLIT = -1


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` by tree and inner place, ``value`` by tree and leaf.

    The raw score is ``base`` plus the tree values of the leaves that a row falls in; the log link takes its exponential.
    """

    columns: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float = 0.0
    log_link: bool = False

    @property
    def n_leaves(self) -> int:
        return self.value.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf in each tree."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        place = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.n_leaves.bit_length() - 1):
            feature = self.feature[trees, place]
            right = (feature != NO_SPLIT) & (x[rows, feature] > self.threshold[trees, place])
            place = 2 * place + 1 + right
        return place - self.feature.shape[1]

    def raw(self, leaves: np.ndarray, added: np.ndarray | None = None) -> np.ndarray:
        """Raw scores of rows by their leaves; ``added`` is laid on top of the leaf values."""
        value = self.value if added is None else self.value + added
        return self.base + value[np.arange(len(value)), leaves].sum(axis=1)

    def respond(self, raw: np.ndarray) -> np.ndarray:
        return np.exp(raw) if self.log_link else raw

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.respond(self.raw(self.leaves(x)))

    def first(self, count: int) -> Trees:
        return Trees(self.columns, self.feature[:count], self.threshold[:count], self.value[:count], self.base, self.log_link)

    def write(self, spark: SparkSession, folder: str) -> None:
        """The trees as a table; the base is row -1."""
        rows = [(-1, int(self.log_link), None, None, float(self.base))]
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            rows += [(t, p, int(f), float(c), None) for p, (f, c) in enumerate(zip(self.feature[t], self.threshold[t]))]
            rows += [(t, inner + leaf, None, None, float(v)) for leaf, v in enumerate(self.value[t])]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)

    @staticmethod
    def read(spark: SparkSession, folder: str, columns: Sequence[str]) -> Trees:
        table = spark.read.parquet(folder).toPandas().sort_values(["tree", "place"])
        head, body = table[table.tree < 0].iloc[0], table[table.tree >= 0]
        count = int(body.tree.max()) + 1
        inner = body[body.feature.notna()]
        return Trees(
            tuple(columns), inner.feature.to_numpy(int).reshape(count, -1), inner.threshold.to_numpy(float).reshape(count, -1),
            body[body.feature.isna()].value.to_numpy(float).reshape(count, -1), float(head["value"]), bool(head["place"]))


def parsed(description: str, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, threshold and leaf values of every tree in MLlib's printed form of a tree or a forest."""
    trees: list[list[tuple]] = []
    for line in description.splitlines():
        found = _LINE.match(line)
        if "Model" in line and not trees or line.strip().startswith("Tree "):
            if not trees or trees[-1]:
                trees.append([])
        elif found:
            trees[-1].append(found.groups())
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.full((len(trees), inner), NO_SPLIT)
    threshold, value = np.zeros((len(trees), inner)), np.zeros((len(trees), leaves))

    def place(t: int, lines: list[tuple], at: int) -> None:
        """The subtree that ``lines`` begin with goes to ``at``."""
        _, word, column, cut, predicted = lines.pop(0)
        if word is None:
            while at < inner:
                at = 2 * at + 1
            value[t, at - inner] = float(predicted)
            return
        feature[t, at], threshold[t, at] = int(column), float(cut)
        place(t, lines, 2 * at + 1)
        lines.pop(0)
        place(t, lines, 2 * at + 2)

    for t, lines in enumerate(trees):
        place(t, lines, 0)
    return feature, threshold, value


def leaf_column(feature: np.ndarray, threshold: np.ndarray, columns: Sequence[str], at: int = 0) -> Column:
    """The leaf of one tree as an expression over the feature columns."""
    inner = len(feature)
    if at >= inner:
        return F.lit(at - inner)
    left = leaf_column(feature, threshold, columns, 2 * at + 1)
    if feature[at] == NO_SPLIT:
        return left
    goes_left = F.col(columns[feature[at]]) <= F.lit(float(threshold[at]))
    return F.when(goes_left, left).otherwise(leaf_column(feature, threshold, columns, 2 * at + 2))


def score(rows: DataFrame, trees: Trees, out: str = "pooled_pred") -> DataFrame:
    """Rows with the trees' response."""
    @F.pandas_udf("double")
    def respond(*columns: pd.Series) -> pd.Series:
        return pd.Series(trees.predict(np.column_stack(columns)))

    return rows.withColumn(out, respond(*[F.col(c).cast("double") for c in trees.columns]))


# --- leaf values of one item -------------------------------------------------------------------

# Weights of an item's own leaf values: a sum of gradients below the first counts nothing, the second pulls to the pooled value.
ITEM_L1, ITEM_L2 = 5.0, 15.0
TWEEDIE_POWER = 1.5


def gradients(raw: np.ndarray, y: np.ndarray, log_link: bool, power: float = TWEEDIE_POWER) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss: Tweedie deviance under the log link, else half the squared error."""
    if not log_link:
        return raw - y, np.ones(len(y))
    a, b = y * np.exp((1 - power) * raw), np.exp((2 - power) * raw)
    return b - a, (power - 1) * a + (2 - power) * b


def newton_step(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return -np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) / (h + l2)


def own_leaves(trees: Trees, x: np.ndarray, y: np.ndarray, l1: float = ITEM_L1, l2: float = ITEM_L2) -> np.ndarray:
    """What is added to every leaf value for the rows of one item, by tree and leaf.

    Each tree takes an equal share of the item's remaining error: in each leaf a Newton step from the pooled score,
    pulled to zero where the item has few rows.
    """
    leaves = trees.leaves(x)
    g, h = gradients(trees.raw(leaves), np.maximum(y, 0.0) if trees.log_link else y, trees.log_link)
    count, width = leaves.shape[1], trees.n_leaves
    slot = (leaves + np.arange(count) * width).ravel()
    sums = [np.bincount(slot, np.repeat(v, count), count * width) for v in (g, h)]
    return (newton_step(*sums, l1, l2) / count).reshape(count, width)


def fit_item_leaves(train: DataFrame, trees: Trees, minimum: int, l1: float = ITEM_L1, l2: float = ITEM_L2) -> DataFrame:
    """Item, added: leaf values of every item of at least ``minimum`` rows, tree after tree."""
    names = list(trees.columns)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < minimum:
            return pd.DataFrame(columns=["Item", "added"], dtype=object)
        added = own_leaves(trees, frame[names].to_numpy(float), frame["Quantity_Sold"].to_numpy(float), l1, l2)
        return pd.DataFrame({"Item": [frame["Item"].iloc[0]], "added": [added.ravel().tolist()]})

    return spread(train.select("Item", "Quantity_Sold", *names), "Item").groupBy("Item").applyInPandas(
        fit, "Item string, added array<double>")


def score_item_leaves(rows: DataFrame, models: DataFrame, trees: Trees) -> DataFrame:
    """Rows without their features, with ``pooled_pred`` and ``item_pred``, the latter NULL for an item without leaf values of its own.

    An item's rows meet its one row of leaf values in a group of their own, so that these aren't copied to every row.
    """
    names = list(trees.columns)
    kept = [c for c in rows.columns if c not in names]
    schema = rows.select(*kept).schema.add("pooled_pred", "double").add("item_pred", "double")

    def join(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=schema.names)
        leaves = trees.leaves(mine[names].to_numpy(float))
        found = mine[kept].assign(pooled_pred=trees.respond(trees.raw(leaves)))
        if not len(model):
            return found.assign(item_pred=np.nan)
        added = np.asarray(model["added"].iloc[0], float).reshape(trees.value.shape)
        return found.assign(item_pred=trees.respond(trees.raw(leaves, added)))

    # Under a name of its own, as the models may come from the same rows.
    own = spread(models.select(F.col("Item").alias("Item"), "added"), "Item").groupBy("Item")
    met = spread(rows, "Item").groupBy("Item").cogroup(own).applyInPandas(join, schema)
    return met.withColumn("item_pred", F.nanvl("item_pred", F.lit(None).cast("double")))

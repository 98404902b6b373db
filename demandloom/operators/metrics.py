"""Forecast accuracy and ABC classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.numeric import safe_ratio
from demandloom.operators.ranking import exact_quantiles, running_total
from demandloom.session import materialise

# Cumulative shares that end class A and class B, and the smallest actual that counts
# for period accuracy.
CLASS_A_SHARE = 0.70
CLASS_B_SHARE = 0.90
MIN_ACTUAL = 2


def wmape(actual: Column, predicted: Column) -> Column:
    return safe_ratio(F.lit(100.0) * F.sum(F.abs(actual - predicted)), F.sum(actual))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def r_squared(actual: Column, predicted: Column) -> Column:
    residual = F.sum((actual - predicted) * (actual - predicted))
    return F.lit(1.0) - safe_ratio(residual, F.var_pop(actual) * F.count(actual))


def volume_accuracy(actual: Column, predicted: Column) -> Column:
    return F.lit(100.0) * (F.lit(1.0) - safe_ratio(F.abs(F.sum(actual) - F.sum(predicted)), F.sum(actual)))


def share_within(actual: Column, predicted: Column, threshold: float) -> Column:
    """Percent of periods with actual >= 2 whose relative error is within the threshold."""
    near = (F.abs(predicted - actual) / actual <= threshold).cast("double")
    return F.coalesce(F.lit(100.0) * F.avg(F.when(actual >= MIN_ACTUAL, near)), F.lit(0.0))


def period_accuracy(actual: Column, predicted: Column) -> Column:
    return F.when(
        actual >= MIN_ACTUAL, F.lit(100.0) * (F.lit(1.0) - F.abs(predicted - actual) / actual)
    )


def forecast_metrics(df: DataFrame, groups: Sequence[str] = (), materialised: bool = False) -> DataFrame:
    """Every accuracy metric, per group or over all rows (one row)."""
    rows = df if materialised else materialise(df)
    keys = list(groups) or ["_all"]
    rows = rows if groups else rows.withColumn("_all", F.lit(1))
    y, p = F.col("Quantity_Sold"), F.col("Predicted")
    sums = rows.groupBy(*keys).agg(
        F.round(r_squared(y, p), 4).alias("r2"),
        F.round(wmape(y, p), 2).alias("wmape"),
        F.round(mae(y, p), 2).alias("mae"),
        F.round(volume_accuracy(y, p), 2).alias("volume_accuracy"),
        F.round(share_within(y, p, 0.2), 1).alias("periods_within_20pct"),
        F.round(share_within(y, p, 0.5), 1).alias("periods_within_50pct"),
        F.count_distinct("Item").alias("n_items"),
    )
    medians = exact_quantiles(
        rows.withColumn("_acc", period_accuracy(y, p)), "_acc", {"_median": 0.5}, keys
    )
    joined = sums.join(medians, keys, "left").withColumn(
        "median_period_accuracy", F.round(F.coalesce("_median", F.lit(0.0)), 1)
    )
    return joined.drop("_median", "_all")


def classify_abc(df: DataFrame, volume: str = "Quantity_Sold") -> DataFrame:
    """Item, Vol, Cum, Pct, Class; the item that crosses a line belongs to the lower class."""
    volumes = materialise(df.groupBy("Item").agg(F.sum(volume).alias("Vol")))
    ranked = running_total(volumes, [F.desc("Vol"), F.col("Item")], F.col("Vol"), "Cum")
    share = safe_ratio(F.col("Cum"), volumes.agg(F.sum("Vol")).scalar())
    return ranked.withColumn("Pct", share).withColumn(
        "Class",
        F.when(F.col("Pct") <= CLASS_A_SHARE, "A").when(F.col("Pct") <= CLASS_B_SHARE, "B").otherwise("C"),
    )


def abc_summary(classified: DataFrame) -> DataFrame:
    """Items, volume and share per class; all three classes always present."""
    spark = classified.sparkSession
    labels = spark.range(1).select(F.explode(F.array(*map(F.lit, "ABC"))).alias("Class"))
    total = classified.agg(F.sum("Vol")).scalar()
    sums = classified.groupBy("Class").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("Vol").alias("total_volume")
    )
    volume = F.coalesce("total_volume", F.lit(0.0))
    return labels.join(sums, "Class", "left").select(
        "Class",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        volume.alias("total_volume"),
        F.round(F.coalesce(safe_ratio(volume, total) * 100, F.lit(0.0)), 1).alias("pct_volume"),
    )


def abc_top_per_class(classified: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` items of each class by volume, as the class view shows them.

    Each class is one run of the global order, so an item's place in it is its global place less
    the class's first: no class is gathered in one task.
    """
    placed = materialise(
        running_total(classified, [F.desc("Vol"), F.col("Item")], F.lit(1).cast("long"), "_n")
    )
    first = placed.groupBy("Class").agg(F.min("_n").alias("_first"))
    return (
        placed.join(first, "Class")
        .withColumn("rank", F.col("_n") - F.col("_first") + 1)
        .where(F.col("rank") <= n)
        .drop("_n", "_first")
    )


def class_metrics(predictions: DataFrame, classified: DataFrame) -> DataFrame:
    """Accuracy per ABC class; classes without rows are absent."""
    labelled = predictions.join(classified.select("Item", "Class"), "Item")
    found = forecast_metrics(labelled, ["Class"])
    return found.select(
        "Class", "n_items", F.round("wmape", 1).alias("wmape"), "median_period_accuracy", "volume_accuracy"
    )


def top_class_a(predictions: DataFrame, classified: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest class-A items with the accuracy of their summed forecast."""
    sums = predictions.groupBy("Item").agg(
        F.sum("Quantity_Sold").alias("Quantity_Sold"), F.sum("Predicted").alias("Predicted")
    )
    y, p = F.col("Quantity_Sold"), F.col("Predicted")
    return (
        sums.join(classified.where(F.col("Class") == "A").select("Item"), "Item", "left_semi")
        .withColumn("accuracy_pct", F.round(F.lit(100.0) * (F.lit(1.0) - safe_ratio(F.abs(p - y), y)), 1))
        .orderBy(F.desc("Quantity_Sold"), "Item")
        .limit(n)
    )


def overfit_check(predictions: DataFrame) -> DataFrame:
    """Train and test metrics side by side with their gap and a verdict on the R2 gap."""
    by_split = forecast_metrics(predictions, ["split"])
    both = by_split.agg(*[
        F.max(F.when(F.col("split") == side, F.col(m))).alias(f"{side}_{m}")
        for side in ("train", "test") for m in ("r2", "wmape", "mae")
    ])
    gap = F.abs(F.col("test_r2") - F.col("train_r2"))
    return both.withColumns({
        **{f"gap_{m}": F.round(F.col(f"test_{m}") - F.col(f"train_{m}"), 4) for m in ("r2", "wmape", "mae")},
        "verdict": F.when(gap > 0.15, "significant").when(gap > 0.05, "moderate").otherwise("acceptable"),
    })


def cv_stability(folds: DataFrame) -> DataFrame:
    """Variance over folds, change from first to last fold, and the two verdicts."""
    return folds.agg(
        F.var_samp("r2").alias("r2_variance"),
        F.var_samp("wmape").alias("wmape_variance"),
        (F.max_by("r2", "fold") - F.min_by("r2", "fold")).alias("r2_change"),
        (F.max_by("wmape", "fold") - F.min_by("wmape", "fold")).alias("wmape_change"),
        F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_std"),
        F.avg("wmape").alias("wmape_mean"), F.stddev_samp("wmape").alias("wmape_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"),
    ).withColumns({
        "high_variance": (F.col("r2_variance") > 0.01) | (F.col("wmape_variance") > 5),
        "degrading": (F.col("r2_change") < -0.05) | (F.col("wmape_change") > 2),
    })

"""Totals over a global order, without a single-task window.

A window with no partition key moves every row to one task. Here the rows are range-partitioned on
the order, each partition keeps its own running total, and one row per partition carries what came
before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import materialise


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    value: Column,
    out: str,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``, the inclusive running sum of ``value`` in ``order`` inside each group.

    ``order`` must be unique inside a group. The range partitioning is materialised, so that both
    passes see the same partition numbers; a hot group is spread over as many partitions as its
    rows need.
    """
    keys = [F.col(name) for name in groups]
    ranged = materialise(
        df.withColumn("_v", value)
        .repartitionByRange(*keys, *order)
        .withColumn("_p", F.spark_partition_id())
    )
    # One row per partition and group that meets it.
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_p", *groups)
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .drop("_t")
    )
    inside = (
        Window.partitionBy("_p", *groups)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = ranged["_p"] == offsets["_p"]
    for name in groups:
        matched = matched & ranged[name].eqNullSafe(offsets[name])
    return (
        ranged.join(offsets, matched)
        .select(ranged["*"], "_o")
        .withColumn(out, F.col("_o") + F.sum("_v").over(inside))
        .drop("_v", "_p", "_o")
    )


def row_numbers(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position in a global order."""
    return running_total(df, order, F.lit(1).cast("long"), out)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], groups: Sequence[str]
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any group size.

    Equal values are counted first, so the range partitioning only sees distinct values, and no
    task holds a whole group.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counted, [F.col(value)], F.col("_n"), "_upto", groups)
    sizes = ranked.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    placed = ranked.join(sizes, list(groups))
    picks = []
    for name, probability in probabilities.items():
        spot = (F.col("_size") - 1) * F.lit(float(probability))
        # A row covers the zero-based ranks [upto - n, upto).
        picks.append(F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(spot), F.col(value))).alias(f"_hi_{name}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"_f_{name}"))
    found = placed.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )

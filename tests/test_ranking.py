"""Global running totals and quantiles against brute force, with hot groups and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators.ranking import exact_quantiles, row_numbers, running_total


def test_running_total_with_ties(spark):
    rng = np.random.default_rng(3)
    # A third of the items share one volume.
    volumes = [5.0 if i % 3 == 0 else float(v) for i, v in enumerate(rng.integers(1, 60, 3000))]
    data = [(f"item{i:05d}", v) for i, v in enumerate(volumes)]
    df = spark.createDataFrame(data, "Item string, Vol double").repartition(13)
    got = {r["Item"]: r["Cum"] for r in running_total(df, [F.desc("Vol"), F.col("Item")], F.col("Vol"), "Cum").collect()}
    expected, total = {}, 0.0
    for item, v in sorted(data, key=lambda d: (-d[1], d[0])):
        total += v
        expected[item] = total
    assert got == expected


def test_running_total_restarts_per_group(spark):
    # One group holds most rows, so it spans several ranges; a missing group is a group too.
    data = [("hot", i, 1.0 + i % 5) for i in range(4000)] + [("cold", i, 2.0) for i in range(7)] + [(None, i, 1.0) for i in range(5)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    out = running_total(df, [F.col("i")], F.col("v"), "upto", ["g"]).collect()
    assert len(out) == len(data)
    for group in ("hot", "cold", None):
        mine = sorted((r["i"], r["v"], r["upto"]) for r in out if r["g"] == group)
        assert [m[2] for m in mine] == list(np.cumsum([m[1] for m in mine]))


def test_rows_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("one").alias("g"), F.col("id").cast("double").alias("v"))
        parts = df.repartitionByRange("g", "v").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert len(parts) == 8 and max(r["count"] for r in parts) < 20000 / 8 * 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("size", [1, 2, 5, 1001])
def test_exact_quantiles(spark, size):
    rng = np.random.default_rng(size)
    groups = {"a": rng.normal(size=size), "b": rng.integers(0, 4, size * 3).astype(float)}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}
    found = {r["g"]: r for r in exact_quantiles(df, "v", wanted, ["g"]).collect()}
    for group, values in groups.items():
        for name, q in wanted.items():
            assert found[group][name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_row_numbers(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(500)], "name string").repartition(7)
    got = row_numbers(df, [F.col("name")], "id").orderBy("name").collect()
    assert [r["id"] for r in got] == list(range(1, 501))

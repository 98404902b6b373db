"""Market-basket rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.numeric import safe_ratio
from demandloom.functions.text import items_of_rule_text
from demandloom.session import materialise, spread


def frequent_itemsets(
    lines: DataFrame, min_support: float, receipt: str = "Receipt number", item: str = "Item"
) -> tuple[DataFrame, int]:
    """Frequent itemsets (items sorted, freq) and the number of baskets.

    Lines are made distinct before the baskets form, and only items that are frequent on their own
    enter a basket: their number is at most the mean basket size over the support, so one huge
    receipt still makes a short basket. Sets grow by one item at a time: a row has a frequent set and
    the later items of a basket that extend it to one, and equal rows are one row with their number.
    """
    pairs = materialise(
        lines.select(F.col(f"`{receipt}`").alias("basket"), F.col(item).alias("item"))
        .where(F.col("item").isNotNull()).distinct()
    )
    baskets = pairs.select("basket").distinct().count()
    least = max(1, math.ceil(min_support * baskets))
    common = materialise(
        pairs.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
        .withColumn("code", F.monotonically_increasing_id())
    )
    names = common.select("code", F.col("item").alias("name"))
    kept = spread(pairs.join(common.select("item", "code"), "item"), "basket").groupBy("basket").agg(
        F.sort_array(F.collect_list("code")).alias("more"))
    sets = common.select("code", F.lit(0).cast("long").alias("within"), "code", F.array("item").alias("items"), "freq").toDF(
        "id", "within", "code", "items", "freq")
    left = _merged(kept.select(F.lit(0).cast("long").alias("within"), "more", F.lit(1).cast("long").alias("times")))
    levels = [sets]
    while True:
        # One row for each item of a basket that extends the set, with the items after it.
        grown = left.select("within", "more", "times", F.posexplode("more").alias("at", "code")).select(
            "within", "code", F.slice("more", F.col("at") + 2, F.size("more")).alias("more"), "times")
        counted = grown.select("within", "code", F.explode("more").alias("next"), "times").groupBy("within", "code", "next").agg(
            F.sum("times").alias("freq")).where(F.col("freq") >= least)
        found = materialise(
            counted.join(sets.select("within", "code", F.col("id").alias("of"), "items"), ["within", "code"])
            .join(names.withColumnRenamed("code", "next"), "next")
            .select(F.monotonically_increasing_id().alias("id"), "within", "code", "of", "next",
                    F.concat("items", F.array("name")).alias("items"), "freq"))
        if found.isEmpty():
            break
        sets = found.select("id", F.col("of").alias("within"), F.col("next").alias("code"), "items", "freq")
        levels.append(sets)
        partners = found.groupBy("within", "code", "of").agg(F.collect_list("next").alias("partners"))
        left = _merged(grown.join(partners, ["within", "code"]).select(
            F.col("of").alias("within"), F.array_intersect("more", "partners").alias("more"), "times"))
    every = reduce(DataFrame.unionByName, levels)
    return materialise(every.select(F.sort_array("items").alias("items"), "freq")), baskets


def _merged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of ``times``; rows without two more items extend nothing."""
    merged = rows.where(F.size("more") >= 2).groupBy("within", "more").agg(F.sum("times").alias("times"))
    return materialise(spread(merged, "within", "more"))


def association_rules(
    lines: DataFrame,
    min_support: float = 0.01,
    min_confidence: float = 0.3,
    receipt: str = "Receipt number",
    item: str = "Item",
) -> DataFrame:
    """Rules with one consequent and all measures, from the supports of the frequent itemsets."""
    itemsets, baskets = frequent_itemsets(lines, min_support, receipt, item)
    whole = itemsets.where(F.size("items") >= 2).withColumn("consequent", F.explode("items"))
    split = whole.select(
        F.array_remove("items", F.col("consequent")).alias("antecedents"),
        F.array("consequent").alias("consequents"),
        F.col("freq").alias("n_ab"),
    )
    left = itemsets.select(F.col("items").alias("antecedents"), F.col("freq").alias("n_a"))
    right = itemsets.where(F.size("items") == 1).select(F.col("items").alias("consequents"), F.col("freq").alias("n_b"))
    return rule_measures(split.join(left, "antecedents").join(right, "consequents"), baskets).where(
        F.col("confidence") >= min_confidence
    )


def rule_measures(counts: DataFrame, baskets: int) -> DataFrame:
    """Measures from the basket counts of antecedent, consequent and both."""
    n = F.lit(float(baskets))
    a, b, ab = (F.col(c) / n for c in ("n_a", "n_b", "n_ab"))
    one = F.lit(1.0)
    confidence = F.col("n_ab") / F.col("n_a").cast("double")
    leverage = ab - a * b
    return counts.select(
        "antecedents", "consequents",
        ab.alias("support"),
        confidence.alias("confidence"),
        (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        # Share of baskets without missing items; a basket here never has any.
        one.alias("representativity"),
        leverage.alias("leverage"),
        safe_ratio(one - b, one - confidence).alias("conviction"),
        safe_ratio(leverage, F.greatest(ab * (one - a), a * (b - ab))).alias("zhangs_metric"),
        safe_ratio(ab, a + b - ab).alias("jaccard"),
    )


def as_rule_text(rules: DataFrame) -> DataFrame:
    """Antecedents and consequents as the set text rule files carry."""

    def text(column: str):
        quoted = F.transform(column, lambda item: F.concat(F.lit("'"), item, F.lit("'")))
        return F.concat(F.lit("frozenset({"), F.array_join(quoted, ", "), F.lit("})"))

    return rules.withColumns({"antecedents": text("antecedents"), "consequents": text("consequents")})


def top_rules(rules: DataFrame, min_confidence: float = 0.3, min_lift: float = 1.0, n: int = 100) -> DataFrame:
    """The ``n`` rules of highest lift above both thresholds."""
    return (
        rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
        .orderBy(F.desc("lift"), "antecedents", "consequents")
        .limit(n)
    )


def rules_for_items(rules: DataFrame, items: DataFrame, min_confidence: float = 0.3, min_lift: float = 1.0) -> DataFrame:
    """Top rules whose consequent is empty or holds one of ``items`` (column ``item``, lower case).

    The limit comes first, as in the rule query this reproduces. With no items at all, no rules.
    """
    top = top_rules(rules, min_confidence, min_lift).withColumn(
        "_wanted", items_of_rule_text(F.col("consequents"))
    )
    keyed = top.withColumn("_key", F.concat_ws("|", "antecedents", "consequents"))
    hits = (
        keyed.withColumn("item", F.explode("_wanted")).join(items.select("item").distinct(), "item", "left_semi")
        .select("_key").distinct().withColumn("_hit", F.lit(True))
    )
    some = items.agg(F.count(F.lit(1))).scalar() > 0
    return (
        keyed.join(hits, "_key", "left")
        .where((F.col("_hit").isNotNull() | (F.size("_wanted") == 0)) & some)
        .drop("_key", "_hit", "_wanted")
    )

"""Queries over trained forecasters. Fits have no SQL twin, except the fold table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from demandloom.forecast import families, folds, perseries, trees
from demandloom.forecast.recursive import recursive_forecast
from demandloom.functions.numeric import rounded
from demandloom.operators import features, metrics, series, serving
from demandloom.plans import queries_features, views  # noqa: F401 - defines shared oracle views
from demandloom.plans.oracle_views import with_
from demandloom.session import materialise
from demandloom.sources.adapters import STAR_CALENDAR

QUERIES, ORACLES = {}, {}

# Three test windows at the end of the given history.
FOLDS = (("2001-02-01", "2001-03-31"), ("2001-04-01", "2001-05-31"), ("2001-06-01", "2001-07-31"))


def _features(spark, sf):
    return materialise(features.create_features(views.item_series(spark, sf), "weekly", STAR_CALENDAR))


def _held_out(spark, sf, family):
    """Only the pooled families read features; the others need the series alone."""
    frame = _features(spark, sf) if family in families.POOLED else views.item_series(spark, sf)
    return families.train_and_predict(frame, family)


def forecast_boosted(spark, sf):
    return _held_out(spark, sf, "boosted")


def forecast_forest(spark, sf):
    return _held_out(spark, sf, "forest")


def forecast_arima(spark, sf):
    return _held_out(spark, sf, "arima")


def forecast_additive(spark, sf):
    return _held_out(spark, sf, "additive")


def holdout_predictions(spark, sf):
    """The pooled Tweedie model with item models blended in, on the hold-out."""
    return _held_out(spark, sf, "tweedie")


def forecast_12w(spark, sf):
    """Twelve weeks ahead from a boosted model of the whole history."""
    weekly = views.item_series(spark, sf)
    codes = materialise(series.item_codes(weekly))
    frame = materialise(features.create_features(weekly, "weekly", STAR_CALENDAR, codes))
    bundle = families.train(frame, "boosted")
    return families.generate_forecast(weekly, bundle, 12, STAR_CALENDAR, codes).select("Item", "Date", "Predicted")


def forecast_items(spark, sf):
    """Four weeks for three items; their codes come from the whole history."""
    weekly = views.item_series(spark, sf)
    codes = materialise(series.item_codes(weekly))
    frame = materialise(features.create_features(weekly, "weekly", STAR_CALENDAR, codes))
    bundle = families.train(frame, "forest")
    wanted = serving.history_for_items(weekly, ["hot ring", "cold ring", "old rod"])
    return families.generate_forecast(wanted, bundle, 4, STAR_CALENDAR, codes).select("Item", "Date", "Predicted")


def forecast_recursive(spark, sf):
    return recursive_forecast(views.item_series(spark, sf, "daily"), 90, STAR_CALENDAR)


def cv_folds(spark, sf):
    """Rows, items and dates of each fold's two sides."""
    rows = families.cv_rows(views.item_series(spark, sf), FOLDS)
    return rows.groupBy("fold", "is_test").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("Item").alias("items"),
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


_FOLDS = ", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(FOLDS, 1))
ORACLES["cv_folds"] = with_("sales", "weekly_sums", "weekly", body=f"""
SELECT fold, "Date" >= s AS is_test, count(*) AS row_count, count(DISTINCT Item) AS items, min("Date") AS first_date, max("Date") AS last_date
FROM weekly JOIN (VALUES {_FOLDS}) f(fold, s, e) ON "Date" <= e GROUP BY 1, 2""")


def _folded(spark, sf):
    frame = materialise(families.without_leaks(_features(spark, sf)))
    predictions = families.cross_validate(
        frame, FOLDS, features.feature_columns("weekly"))
    return families.cv_metrics(materialise(predictions))


def cv_metrics(spark, sf):
    return _folded(spark, sf)


def cv_stability(spark, sf):
    return metrics.cv_stability(materialise(_folded(spark, sf)))


def _fold_frames(spark, sf):
    return folds.fold_frames(views.item_series(spark, sf), FOLDS, STAR_CALENDAR, "hot ring")


# Columns of the folds' frames that the oracle recomputes.
_FOLDED = ("Quantity_Sold", "Lag_1", "Roll_Mean_8", "Roll_Std_8", "Diff_4", "Rebrand_Surge", "Item_Surge")


def cv_frame(spark, sf):
    """The folds' rows with columns clipped, and surges computed, by each fold's past."""
    return _fold_frames(spark, sf).select(
        "fold", "is_test", "Item", "Date", *[rounded(c, 6).alias(c) for c in _FOLDED])


def _back(periods: int) -> str:
    return f'OVER (PARTITION BY Item ORDER BY "Date" ROWS BETWEEN {periods} PRECEDING AND 1 PRECEDING)'


_EVENT = f"DATE '{STAR_CALENDAR.event_date}'"
ORACLES["cv_frame"] = with_("sales", "weekly_sums", "weekly", body=f"""
, plain AS (SELECT Item, "Date", q, lag(q, 1) OVER o AS Lag_1, avg(q) {_back(8)} AS Roll_Mean_8, stddev_samp(q) {_back(8)} AS Roll_Std_8,
   lag(q, 1) OVER o - lag(q, 5) OVER o AS Diff_4 FROM weekly WINDOW o AS (PARTITION BY Item ORDER BY "Date")),
rows_of AS (SELECT fold, "Date" >= s AS is_test, p.* FROM plain p JOIN (VALUES {_FOLDS}) f(fold, s, e) ON "Date" <= e),
means AS (SELECT *, avg(q) FILTER (NOT is_test AND "Date" < {_EVENT}) OVER i AS pre, avg(q) FILTER (NOT is_test AND "Date" >= {_EVENT}) OVER i AS post
   FROM rows_of WINDOW i AS (PARTITION BY fold, Item)),
x AS (SELECT fold, is_test, Item, "Date", q::DOUBLE AS Quantity_Sold, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in _FOLDED[1:5])},
   coalesce(CASE WHEN post IS NULL THEN 1 ELSE least(post / (pre + 1), 2) END, 0)::DOUBLE AS Rebrand_Surge,
   CASE WHEN Item = 'hot ring' AND "Date" >= {_EVENT} AND pre IS NOT NULL AND post IS NOT NULL
    THEN least(post / (pre + 1), 3) * greatest(0.3, 1 - ("Date" - {_EVENT}) / 140.0::DOUBLE) ELSE 1 END::DOUBLE AS Item_Surge FROM means),
b AS (SELECT fold, {', '.join(f'quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}' for c in _FOLDED)} FROM x WHERE NOT is_test GROUP BY fold)
SELECT fold, is_test, Item, "Date", round(CASE WHEN is_test THEN Quantity_Sold ELSE greatest(lo_Quantity_Sold, least(hi_Quantity_Sold, Quantity_Sold)) END, 6) AS Quantity_Sold,
 {', '.join(f'round(greatest(lo_{c}, least(hi_{c}, {c})), 6) + 0.0 AS {c}' for c in _FOLDED[1:])} FROM x JOIN b USING (fold)""")


def cv_exploratory(spark, sf):
    """Fold by fold on the exploratory frame, with mean and deviation over the folds."""
    frame = materialise(_fold_frames(spark, sf))
    columns = [c for c in frame.columns if c not in (*folds.KEYS, "Quantity_Sold")]
    found = materialise(families.cv_metrics(families.cross_validate(frame, FOLDS, columns)))
    steady = metrics.cv_stability(found)
    over = [steady.select(F.lit(kind).alias("fold"), *[F.col(f"{m}_{kind}").alias(m) for m in ("r2", "wmape", "mae")]) for kind in ("mean", "std")]
    single = found.select(F.col("fold").cast("string"), "r2", "wmape", "mae", "valid_predictions")
    return single.unionByName(over[0], allowMissingColumns=True).unionByName(over[1], allowMissingColumns=True)


# A fixed ensemble over two lags and the month: three trees of depth 2, by feature, threshold and leaf value.
FIXED_TREES = trees.Trees(
    ("Lag_1", "Lag_2", "Month"),
    np.array([[0, 1, 2], [2, 0, 1], [1, trees.NO_SPLIT, 0]]),
    np.array([[150.0, 80.0, 6.0], [4.0, 120.0, 200.0], [140.0, 0.0, 160.0]]),
    np.array([[-0.3, -0.1, 0.1, 0.3], [-0.2, 0.1, 0.0, 0.2], [-0.1, -0.1, 0.1, 0.2]]), base=5.0, log_link=True)


def item_leaf_values(spark, sf):
    """What each item with 100 weeks adds to the leaf values of a fixed ensemble."""
    weekly = views.item_series(spark, sf)
    rows = weekly.withColumns(features.lag_columns((1, 2))).withColumn("Month", F.month("Date")).na.fill(0)
    own = trees.fit_item_leaves(rows, FIXED_TREES, 100)
    wide = FIXED_TREES.n_leaves
    return own.select("Item", F.posexplode("added").alias("place", "added")).where("added <> 0").select(
        "Item", F.floor(F.col("place") / wide).cast("int").alias("tree"), (F.col("place") % wide).alias("leaf"), rounded("added", 6).alias("added"))


def _leaf_sql(tree: int, at: int = 0) -> str:
    inner = FIXED_TREES.feature.shape[1]
    if at >= inner:
        return str(at - inner)
    feature = FIXED_TREES.feature[tree, at]
    left = _leaf_sql(tree, 2 * at + 1)
    if feature == trees.NO_SPLIT:
        return left
    return f"CASE WHEN {FIXED_TREES.columns[feature]} <= {FIXED_TREES.threshold[tree, at]} THEN {left} ELSE {_leaf_sql(tree, 2 * at + 2)} END"


_VALUES = ", ".join(f"({t}, {k}, {v})" for t, row in enumerate(FIXED_TREES.value) for k, v in enumerate(row))
ORACLES["item_leaf_values"] = with_("sales", "weekly_sums", "weekly", body=f"""
, x AS (SELECT Item, "Date", q, coalesce(lag(q, 1) OVER o, 0) AS Lag_1, coalesce(lag(q, 2) OVER o, 0) AS Lag_2, month("Date") AS Month, count(*) OVER (PARTITION BY Item) AS n
   FROM weekly WINDOW o AS (PARTITION BY Item ORDER BY "Date")),
placed AS (SELECT Item, "Date", q, unnest([0, 1, 2]) AS tree, unnest([{', '.join(_leaf_sql(t) for t in range(3))}]) AS leaf FROM x WHERE n >= 100),
scored AS (SELECT p.*, 5.0 + sum(v) OVER (PARTITION BY Item, "Date") AS m FROM placed p JOIN (VALUES {_VALUES}) l(tree, leaf, v) USING (tree, leaf)),
sums AS (SELECT Item, tree, leaf, sum(exp(m / 2) - q * exp(-m / 2)) AS g, sum((exp(m / 2) + q * exp(-m / 2)) / 2) AS h FROM scored GROUP BY 1, 2, 3)
SELECT Item, CAST(tree AS INT) AS tree, CAST(leaf AS INT) AS leaf, round(-sign(g) * (abs(g) - 5) / (h + 15) / 3, 6) + 0.0 AS added FROM sums WHERE abs(g) > 5""")


# Parameters of item models, as a fit would leave them: by the length of the item's name, fixed.
def _arima_models(weekly):
    last = weekly.groupBy("Item").agg(F.max("Date").alias("last_date"), F.max_by("Quantity_Sold", "Date").alias("last_value"))
    size = F.length("Item")
    return last.select(
        "Item", "last_date", "last_value", ((size % 9) / 10.0 - 0.4).alias("phi"), F.lit(0.0).alias("theta"), ((size % 5) - 2.0).alias("next_step"))


def arima_path(spark, sf):
    """Twelve weeks of every item under given ARIMA(1,1,1) parameters."""
    weekly = views.item_series(spark, sf)
    found = perseries.score_arima(series.future_grid(weekly, 12), _arima_models(weekly), 7)
    return found.select("Item", "Date", rounded("item_pred", 6).alias("item_pred"))


_GRID = """SELECT i.Item, l.last + CAST(7 * k AS INT) AS "Date", k, last FROM (SELECT DISTINCT Item FROM weekly) i, (SELECT max("Date") AS last FROM weekly) l, generate_series(1, 12) t(k)"""
ORACLES["arima_path"] = with_("sales", "weekly_sums", "weekly", body=f"""
, par AS (SELECT Item, max("Date") AS l, arg_max(q, "Date") AS v, (length(Item) % 9) / 10.0::DOUBLE - 0.4::DOUBLE AS phi, (length(Item) % 5) - 2.0::DOUBLE AS step FROM weekly GROUP BY Item),
grid AS ({_GRID})
SELECT Item, "Date", round(v + step * list_sum(list_transform(range(0, CAST(("Date" - l) // 7 AS BIGINT)), lambda j: pow(phi, j))), 6) + 0.0 AS item_pred FROM grid JOIN par USING (Item)""")


def additive_path(spark, sf):
    """Twelve weeks of every item under given weights of trend, hinges and waves."""
    weekly = views.item_series(spark, sf)
    count = 2 + perseries.CHANGEPOINTS + 2 * (perseries.YEARLY + perseries.WEEKLY)
    models = weekly.groupBy("Item").agg(F.min("Date").alias("origin"), F.date_diff(F.max("Date"), F.min("Date")).cast("double").alias("span")).where("span > 0").select(
        "Item", "origin", "span", F.lit(10.0).alias("scale"),
        F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: ((k * F.length("Item")) % 7 - 3) / 10.0).alias("weights"))
    found = perseries.score_additive(series.future_grid(weekly, 12), models)
    return found.select("Item", "Date", rounded("item_pred", 6).alias("item_pred"))


ORACLES["additive_path"] = with_("sales", "weekly_sums", "weekly", body=f"""
, par AS (SELECT Item, min("Date") AS o, (max("Date") - min("Date"))::DOUBLE AS span FROM weekly GROUP BY Item HAVING max("Date") > min("Date")),
grid AS ({_GRID}),
places AS (SELECT grid.Item, "Date", ("Date" - o) / span AS t, ("Date" - DATE '1970-01-01')::DOUBLE AS d FROM grid LEFT JOIN par USING (Item)),
terms AS (SELECT *, list_concat([1.0::DOUBLE, t], list_concat(
  list_transform(range(1, {perseries.CHANGEPOINTS + 1}), lambda k: greatest(0, t - 0.8::DOUBLE * k / {perseries.CHANGEPOINTS + 1})),
  list_concat(flatten(list_transform(range(1, {perseries.YEARLY + 1}), lambda k: [sin(2 * pi() * k * d / 365.25), cos(2 * pi() * k * d / 365.25)])),
   flatten(list_transform(range(1, {perseries.WEEKLY + 1}), lambda k: [sin(2 * pi() * k * d / 7), cos(2 * pi() * k * d / 7)]))))) AS x FROM places)
SELECT Item, "Date", CASE WHEN t IS NOT NULL THEN round(10 * list_dot_product(x::DOUBLE[], list_transform(range(1, len(x) + 1), lambda k: ((k * length(Item)) % 7 - 3) / 10.0::DOUBLE)), 6) + 0.0 END AS item_pred FROM terms""")


def overfit_check(spark, sf):
    return families.overfit_check(_features(spark, sf), "boosted")


def model_comparison(spark, sf):
    return families.compare(_features(spark, sf))[0]


QUERIES |= {
    f.__name__: f for f in (
        forecast_boosted, forecast_forest, forecast_arima, forecast_additive, holdout_predictions, forecast_12w,
        forecast_items, forecast_recursive, cv_folds, cv_metrics, cv_stability, cv_frame, cv_exploratory, item_leaf_values,
        arima_path, additive_path, overfit_check, model_comparison)
}

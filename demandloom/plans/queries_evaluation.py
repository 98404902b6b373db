"""Queries over accuracy metrics, ABC classes, stored forecasts and the run registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.numeric import rounded
from demandloom.operators import bom, metrics, registry, serving
from demandloom.plans import queries_features, views  # noqa: F401 - defines shared oracle views
from demandloom.plans.oracle_views import VIEWS, with_
from demandloom.plans.queries_cleaning import ITEM_DIM_SQL
from demandloom.plans.queries_supply import RECIPE_SQL, RECIPE_VIEWS, material_name_sql
from demandloom.session import materialise
from demandloom.sources import adapters

QUERIES, ORACLES = {}, {}
_HELD = ("sales", "weekly_sums", "weekly", "heldout")
_ABC = ("sales", "vol", "abc")

_METRICS = """round(1 - sum((q - p) * (q - p)) / (var_pop(q) * count(*)), 4) AS r2, round(100 * sum(abs(q - p)) / sum(q), 2) AS wmape, round(avg(abs(q - p)), 2) AS mae,
 round(100.0 * (1 - abs(sum(q) - sum(p)) / sum(q)), 2) AS volume_accuracy,
 round(coalesce(100.0 * avg(CAST(abs(p - q) / q <= 0.2 AS DOUBLE)) FILTER (q >= 2), 0), 1) AS periods_within_20pct,
 round(coalesce(100.0 * avg(CAST(abs(p - q) / q <= 0.5 AS DOUBLE)) FILTER (q >= 2), 0), 1) AS periods_within_50pct,
 count(DISTINCT Item) AS n_items, round(coalesce(median(100.0::DOUBLE * (1 - abs(p - q) / q)) FILTER (q >= 2), 0), 1) AS median_period_accuracy"""


def forecast_metrics(spark, sf):
    return metrics.forecast_metrics(views.held_out_naive(spark, sf), materialised=True)


ORACLES["forecast_metrics"] = with_(*_HELD, body=f"SELECT {_METRICS} FROM heldout")


def overfit_check_naive(spark, sf):
    """The check on the naive forecast: odd weeks of the hold-out stand for training, even ones for the test."""
    held = views.held_out_naive(spark, sf)
    side = F.when(F.weekofyear("Date") % 2 == 1, "train").otherwise("test")
    return metrics.overfit_check(materialise(held.withColumn("split", side)))


ORACLES["overfit_check_naive"] = with_(*_HELD, body=f"""
, m AS (SELECT CASE WHEN week("Date") % 2 = 1 THEN 'train' ELSE 'test' END AS side, {_METRICS} FROM heldout GROUP BY 1),
w AS (SELECT {', '.join(f"max({x}) FILTER (side = '{side}') AS {side}_{x}" for side in ('train', 'test') for x in ('r2', 'wmape', 'mae'))} FROM m)
SELECT *, {', '.join(f'round(test_{x} - train_{x}, 4) AS gap_{x}' for x in ('r2', 'wmape', 'mae'))},
 CASE WHEN abs(test_r2 - train_r2) > 0.15 THEN 'significant' WHEN abs(test_r2 - train_r2) > 0.05 THEN 'moderate' ELSE 'acceptable' END AS verdict FROM w""")


def cv_stability_naive(spark, sf):
    """Stability of the naive forecast over three folds of the hold-out, by month."""
    held = views.held_out_naive(spark, sf).withColumn("fold", F.month("Date") % 3 + 1)
    y, p = F.col("Quantity_Sold"), F.col("Predicted")
    folds = held.where("Quantity_Sold > 0").groupBy("fold").agg(
        F.round(metrics.r_squared(y, p), 6).alias("r2"), F.round(metrics.wmape(y, p), 6).alias("wmape"), F.round(metrics.mae(y, p), 6).alias("mae"))
    found = metrics.cv_stability(folds)
    return found.withColumns({c: rounded(c, 4) for c, kind in found.dtypes if kind == "double"})


ORACLES["cv_stability_naive"] = with_(*_HELD, body="""
, f AS (SELECT month("Date") % 3 + 1 AS fold, round(1 - sum((q - p) * (q - p)) / (var_pop(q) * count(*)), 6) AS r2, round(100 * sum(abs(q - p)) / sum(q), 6) AS wmape,
 round(avg(abs(q - p)), 6) AS mae FROM heldout WHERE q > 0 GROUP BY 1),
c AS (SELECT var_samp(r2) AS rv, var_samp(wmape) AS wv, max_by(r2, fold) - min_by(r2, fold) AS rc, max_by(wmape, fold) - min_by(wmape, fold) AS wc FROM f)
SELECT round(rv, 4) AS r2_variance, round(wv, 4) AS wmape_variance, round(rc, 4) AS r2_change, round(wc, 4) AS wmape_change,
 round(avg(r2), 4) AS r2_mean, round(stddev_samp(r2), 4) AS r2_std, round(avg(wmape), 4) AS wmape_mean, round(stddev_samp(wmape), 4) AS wmape_std,
 round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std, rv > 0.01 OR wv > 5 AS high_variance, rc < -0.05 OR wc > 2 AS degrading
FROM f, c GROUP BY rv, wv, rc, wc""")


def abc_classification(spark, sf):
    found = metrics.classify_abc(adapters.item_volumes(spark, sf))
    return found.withColumn("Pct", rounded("Pct", 6))


ORACLES["abc_classification"] = with_(*_ABC, body="SELECT Item, vol AS Vol, cum AS Cum, round(pct, 6) AS Pct, cls AS Class FROM abc")


def abc_summary(spark, sf):
    return metrics.abc_summary(metrics.classify_abc(adapters.item_volumes(spark, sf)))


_SUMMARY = """SELECT Class, coalesce(n_items, 0) AS n_items, coalesce(v, 0.0) AS total_volume, round(coalesce(v, 0) / (SELECT sum(vol) FROM abc) * 100, 1) AS pct_volume
FROM (VALUES ('A'), ('B'), ('C')) c(Class) LEFT JOIN (SELECT cls, count(*) AS n_items, sum(vol) AS v FROM abc GROUP BY 1) s ON s.cls = Class"""
ORACLES["abc_summary"] = with_(*_ABC, body=_SUMMARY)


def abc_top_per_class(spark, sf):
    found = metrics.abc_top_per_class(metrics.classify_abc(adapters.item_volumes(spark, sf)), 10)
    return found.withColumn("Pct", rounded("Pct", 6))


ORACLES["abc_top_per_class"] = with_(*_ABC, body="""
SELECT * FROM (SELECT Item, vol AS Vol, cum AS Cum, round(pct, 6) AS Pct, cls AS Class, row_number() OVER (PARTITION BY cls ORDER BY vol DESC, Item) AS rank FROM abc) WHERE rank <= 10""")


def abc_class_metrics(spark, sf):
    held = views.held_out_naive(spark, sf)
    return metrics.class_metrics(held, materialise(metrics.classify_abc(held)))


_HELD_ABC = f"""
, hv AS (SELECT Item, sum(q) AS vol FROM heldout GROUP BY 1), habc AS ({VIEWS['abc'].replace('FROM vol)', 'FROM hv)')})"""
ORACLES["abc_class_metrics"] = with_(*_HELD, body=_HELD_ABC + f"""
SELECT Class, n_items, round(wmape, 1) AS wmape, median_period_accuracy, volume_accuracy FROM (
 SELECT cls AS Class, {_METRICS} FROM heldout JOIN habc USING (Item) GROUP BY 1)""")


def top_class_a(spark, sf):
    held = views.held_out_naive(spark, sf)
    return metrics.top_class_a(held, metrics.classify_abc(held))


ORACLES["top_class_a"] = with_(*_HELD, body=_HELD_ABC + """
SELECT Item, sum(q) AS Quantity_Sold, sum(p) AS Predicted, round(100.0 * (1 - abs(sum(p) - sum(q)) / sum(q)), 1) AS accuracy_pct
FROM heldout JOIN habc USING (Item) WHERE cls = 'A' GROUP BY Item ORDER BY 2 DESC, 1 LIMIT 10""")


def abc_from_forecast(spark, sf):
    volumes = registry.run_volumes(views.run_tables(spark, sf), "forest")
    found = metrics.classify_abc(volumes)
    return found.withColumn("Pct", rounded("Pct", 6))


def _latest(family: str | None = None) -> str:
    wanted = f"AND model_type = '{family}'" if family else ""
    return f"SELECT * FROM runs WHERE is_active {wanted} ORDER BY trained_at DESC, id DESC LIMIT 1"


ORACLES["abc_from_forecast"] = with_("runs", "forecasts", body=f"""
, fv AS (SELECT item_name AS Item, sum(quantity_predicted) AS vol FROM forecasts WHERE model_run_id = (SELECT id FROM ({_latest('forest')})) GROUP BY 1),
fabc AS ({VIEWS['abc'].replace('FROM vol)', 'FROM fv)')})
SELECT Item, vol AS Vol, cum AS Cum, round(pct, 6) AS Pct, cls AS Class FROM fabc""")


def latest_active_run(spark, sf):
    found = registry.latest_active_run(views.run_tables(spark, sf).runs, "boosted")
    return found.select("id", "model_type", F.col("trained_at").cast("timestamp_ntz").alias("trained_at"), "n_records")


ORACLES["latest_active_run"] = with_("runs", body=f"SELECT id, model_type, trained_at, n_records FROM ({_latest('boosted')})")


def run_metrics(spark, sf):
    found = registry.run_metrics(views.run_tables(spark, sf).runs)
    return found.select(*[rounded(c, 6).alias(c) for c in found.columns])


ORACLES["run_metrics"] = with_("runs", body=f"""
SELECT {', '.join(f'round(coalesce({m}, 0), 6) AS {m}' for m in registry.RUN_METRICS)} FROM ({_latest()})""")


def forecast_summary(spark, sf):
    found = registry.forecast_summary(views.run_tables(spark, sf), "forest")
    return found.withColumns({c: rounded(c, 6) for c in ("wmape", "accuracy", "r2", "mae", "periods_within_20pct", "periods_within_50pct")})


ORACLES["forecast_summary"] = with_("runs", "class_metrics", "top_rows", body=f"""
, r AS ({_latest('forest')})
SELECT 'global' AS kind, NULL AS name, (SELECT CAST(sum(n_items) AS BIGINT) FROM class_metrics WHERE model_run_id = (SELECT id FROM r)) AS n_items, round(wmape, 6) AS wmape, round(CASE WHEN median_period_accuracy <> 0 THEN median_period_accuracy ELSE volume_accuracy END, 6) AS accuracy,
 round(coalesce(r2, 0), 6) AS r2, round(mae, 6) AS mae, round(periods_within_20pct, 6) AS periods_within_20pct,
 round(coalesce(periods_within_50pct, 0), 6) AS periods_within_50pct, NULL::DOUBLE AS quantity_sold, NULL::DOUBLE AS predicted FROM r
UNION ALL SELECT 'class', abc_class, n_items, round(wmape, 6), round(coalesce(nullif(median_period_accuracy, 0), volume_accuracy), 6), NULL, NULL, NULL, NULL, NULL, NULL
 FROM class_metrics WHERE model_run_id = (SELECT id FROM r)
UNION ALL SELECT 'item', item_name, NULL, NULL, round(accuracy_pct, 6), NULL, NULL, NULL, NULL, quantity_sold, predicted FROM top_rows WHERE model_run_id = (SELECT id FROM r)""")


def global_mean_forecast(spark, sf):
    return views.mean_forecast(views.item_series(spark, sf, "daily")).select("Item", "Date", "Predicted")


VIEWS["meanf"] = """
 SELECT g.Item, g."Date", round_even((SELECT avg(q) FROM dailyseries) * coalesce(f, 1.0), 0) AS p FROM (
  SELECT Item, CAST(d AS DATE) AS "Date" FROM (SELECT DISTINCT Item FROM dailyseries),
   (SELECT unnest(generate_series(max("Date") + 1, max("Date") + 84, INTERVAL 1 DAY)) AS d FROM dailyseries)) g
 LEFT JOIN factors f ON f.Item = g.Item AND f.d = isodow(g."Date") - 1"""
_MEANF = ("sales", "dailyseries", "factors", "meanf")
ORACLES["global_mean_forecast"] = with_(*_MEANF, body='SELECT Item, "Date", p AS Predicted FROM meanf')


def forecast_page(spark, sf):
    stored = views.mean_forecast(views.item_series(spark, sf, "daily")).select(
        F.col("Date").alias("date"), F.col("Item").alias("item"), F.col("Predicted").alias("quantity_sold"))
    return serving.forecast_page(stored, start="2001-08-15", end="2001-09-30", page=2, size=500)


ORACLES["forecast_page"] = with_(*_MEANF, body="""
SELECT "Date" AS date, Item AS item, p AS quantity_sold FROM meanf WHERE "Date" BETWEEN DATE '2001-08-15' AND DATE '2001-09-30' ORDER BY 1, 2 LIMIT 500 OFFSET 500""")


def forecast_totals(spark, sf):
    tables = views.run_tables(spark, sf)
    return serving.forecast_totals(tables.forecasts)


ORACLES["forecast_totals"] = with_("forecasts", body="SELECT date, sum(quantity_predicted) AS total FROM forecasts GROUP BY date")


def forecast_persist(spark, sf):
    forecast = views.mean_forecast(views.item_series(spark, sf, "daily"))
    return registry.resolve_items(forecast, views.item_dim(spark, sf), 7)


ORACLES["forecast_persist"] = f"""WITH cats AS ({VIEWS['cats']}), {ITEM_DIM_SQL}, """ + with_(*_MEANF, body="""
SELECT 7 AS model_run_id, d.id AS item_id, "Date" AS date, p AS quantity_predicted FROM meanf JOIN dimitems d ON d.name = Item""").removeprefix("WITH ")


def forecast_materials(spark, sf):
    """Material needs of the mean forecast: filtered by name and date, second page."""
    forecast = views.mean_forecast(views.item_series(spark, sf, "daily")).select(
        "Date", "Item", F.col("Predicted").alias("Quantity"))
    needs = bom.material_requirements(forecast, adapters.menu_bom(spark, sf), adapters.condiment_bom(spark, sf))
    stored = needs.toDF("date", "raw_material", "quantity_required")
    found = serving.materials_page(stored, "a", "2001-08-10", "2001-10-10", page=2, size=300)
    return found.withColumn("quantity_required", rounded("quantity_required", 4))


VIEWS["fneeds"] = f"""
 SELECT "Date" AS date, {material_name_sql('leaf')} AS raw_material, sum(m.p * l.f) AS q FROM meanf m JOIN item_leaf l USING (Item) WHERE m.p > 0 GROUP BY 1, 2"""
ORACLES["forecast_materials"] = with_(*_MEANF, "cond", "walk", "leaves", "bom", "item_leaf", "fneeds", recursive=True, body="""
SELECT date, raw_material, round(q, 4) AS quantity_required FROM fneeds WHERE raw_material ILIKE '%a%' AND date BETWEEN DATE '2001-08-10' AND DATE '2001-10-10'
ORDER BY 1, 2 LIMIT 300 OFFSET 300""")


def forecast_recipe_materials(spark, sf):
    """Material needs of the mean forecast through the recipe schema, first page of a date range."""
    forecast = views.mean_forecast(views.item_series(spark, sf, "daily")).select(
        "Date", "Item", F.col("Predicted").alias("Quantity"))
    wanted = serving.between(forecast, "2001-08-10", "2001-08-20", column="Date")
    needs = bom.recipe_requirements(wanted, adapters.recipe_tables(spark, sf))
    found = serving.page_of(needs, ["Date", "Raw_Material"], 1, 1000)
    return found.withColumn("Quantity_Required", rounded("Quantity_Required", 3))


ORACLES["forecast_recipe_materials"] = with_(*_MEANF, *RECIPE_VIEWS, body=RECIPE_SQL + """,
sold AS (SELECT "Date", lower(Item) AS key, sum(p) AS q FROM meanf WHERE "Date" BETWEEN DATE '2001-08-10' AND DATE '2001-08-20' GROUP BY 1, 2)
SELECT "Date", raw AS Raw_Material, round(sum(q * qty), 3) AS Quantity_Required FROM sold JOIN unit USING (key) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000""")


def registry_after_retrain(spark, sf):
    """The registry after a boosted retrain whose forecasts are the naive hold-out."""
    tables = views.run_tables(spark, sf)
    held = views.held_out_naive(spark, sf)
    classified = materialise(metrics.classify_abc(held))
    found = metrics.forecast_metrics(held, materialised=True)
    run_id = registry.next_run_id(tables.runs).scalar()
    new_run = found.select(
        run_id.alias("id"), F.lit("boosted").alias("model_type"), F.lit("2002-01-01").cast("timestamp").alias("trained_at"),
        "r2", "wmape", "mae", "median_period_accuracy", "volume_accuracy", "periods_within_20pct", "periods_within_50pct",
        F.lit(True).alias("is_active"))
    classes = metrics.class_metrics(held, classified).select(
        run_id.alias("model_run_id"), F.col("Class").alias("abc_class"), "n_items", "wmape", "volume_accuracy", "median_period_accuracy")
    top = metrics.top_class_a(held, classified).select(
        run_id.alias("model_run_id"), F.col("Item").alias("item_name"), F.col("Quantity_Sold").alias("quantity_sold"),
        F.col("Predicted").alias("predicted"), "accuracy_pct")
    forecasts = held.select(
        run_id.alias("model_run_id"), F.col("Item").alias("item_name"), F.col("Date").alias("date"),
        F.col("Predicted").alias("quantity_predicted"))
    after = registry.record_run(tables, new_run, classes, top, forecasts)
    rows = {
        name: child.groupBy("model_run_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        for name, child in after.children().items()
    }
    joined = after.runs.withColumn("model_run_id", F.col("id"))
    for counted in rows.values():
        joined = joined.join(counted, "model_run_id", "left")
    return joined.select("id", "model_type", "is_active", rounded("r2", 4).alias("r2"), rounded("wmape", 4).alias("wmape"),
                         *[f"n_{name}" for name in rows])


ORACLES["registry_after_retrain"] = with_(*_HELD, "runs", "forecasts", "class_metrics", "top_rows", body=_HELD_ABC + f"""
, new AS (SELECT (SELECT max(id) + 1 FROM runs) AS id, {_METRICS} FROM heldout)
SELECT r.id, model_type, is_active AND model_type <> 'boosted' AS is_active, round(r2, 4) AS r2, round(wmape, 4) AS wmape,
 (SELECT count(*) FROM class_metrics c WHERE c.model_run_id = r.id) AS n_class_metrics, (SELECT count(*) FROM top_rows t WHERE t.model_run_id = r.id) AS n_top_items,
 (SELECT count(*) FROM forecasts f WHERE f.model_run_id = r.id) AS n_forecasts FROM runs r
UNION ALL SELECT id, 'boosted', true, r2, wmape, (SELECT count(DISTINCT cls) FROM habc), (SELECT least(count(*), 10) FROM habc WHERE cls = 'A'), (SELECT count(*) FROM heldout) FROM new""")


def registry_cleanup(spark, sf):
    """Rows left and rows lost per table."""
    tables = views.run_tables(spark, sf)
    kept, lost = registry.cleanup(tables)
    counts = {"runs": kept.runs, **kept.children()}
    return lost.select("*", *[
        d.agg(F.count(F.lit(1))).scalar().alias(f"kept_{name}") for name, d in counts.items()])


_GONE = "SELECT id FROM runs WHERE NOT is_active"
ORACLES["registry_cleanup"] = with_("runs", "forecasts", "class_metrics", "top_rows", body="SELECT " + ", ".join(
    f"(SELECT count(*) FROM {t} WHERE {k} IN ({_GONE})) AS deleted_{n}, (SELECT count(*) FROM {t} WHERE {k} NOT IN ({_GONE})) AS kept_{n}"
    for n, t, k in (("runs", "runs", "id"), ("class_metrics", "class_metrics", "model_run_id"),
                    ("top_items", "top_rows", "model_run_id"), ("forecasts", "forecasts", "model_run_id"))))

QUERIES |= {name: globals()[name] for name in ORACLES}

"""Model runs: lookup, recording a retrain, cleanup, ABC persistence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.text import items_of_json_text
from demandloom.session import materialise

RUN_METRICS = (
    "r2", "wmape", "mae", "median_period_accuracy", "periods_within_20pct", "periods_within_50pct",
)


@dataclass(frozen=True)
class RunTables:
    """The registry and its child tables.

    ``item_models`` (model_run_id, item_name) has the items with a model of their own; registries without it carry
    them as JSON text in the run's row.
    """

    runs: DataFrame
    class_metrics: DataFrame
    top_items: DataFrame
    forecasts: DataFrame
    item_models: DataFrame | None = None

    def children(self) -> dict[str, DataFrame]:
        found = {
            "class_metrics": self.class_metrics, "top_items": self.top_items, "forecasts": self.forecasts,
            "item_models": self.item_models,
        }
        return {name: child for name, child in found.items() if child is not None}


def latest_active_run(runs: DataFrame, family: str | None = None) -> DataFrame:
    """The active run trained last (zero or one row); ties by id."""
    active = runs.where(F.col("is_active"))
    if family is not None:
        active = active.where(F.col("model_type") == family)
    return active.orderBy(F.desc("trained_at"), F.desc("id")).limit(1)


def items_of_run(tables: RunTables, family: str | None = None) -> DataFrame:
    """item (lower case): the latest active run's items with models, from its rows and its text; none without a run or a list."""
    run = materialise(latest_active_run(tables.runs, family))
    found = []
    if "items_with_models" in run.columns:
        found.append(run.select(F.explode(items_of_json_text(F.col("items_with_models"))).alias("item")))
    if tables.item_models is not None:
        rows = tables.item_models.join(run.select(F.col("id").alias("model_run_id")), "model_run_id", "left_semi")
        found.append(rows.select(F.lower(F.trim("item_name")).alias("item")).where("item <> ''"))
    return reduce(DataFrame.unionByName, found).distinct()


def run_metrics(runs: DataFrame, family: str | None = None) -> DataFrame:
    """Metrics of the latest active run; one row of zeros when there is none."""
    latest = latest_active_run(runs, family)
    return latest.agg(*[
        F.coalesce(F.max(m).cast("double"), F.lit(0.0)).alias(m) for m in RUN_METRICS
    ])


def forecast_summary(tables: RunTables, family: str | None = None) -> DataFrame:
    """Global, class and item rows of the latest active run in one long table.

    A missing or zero period accuracy falls back to the volume accuracy; the global item count is the
    sum over the classes. Without an active run there is one global row of zeros.
    """
    run = latest_active_run(tables.runs, family)

    def or_volume():
        return F.coalesce(
            F.nullif(F.col("median_period_accuracy"), F.lit(0.0)),
            F.nullif(F.col("volume_accuracy"), F.lit(0.0)),
            F.lit(0.0),
        )

    none = F.lit(None)
    of_run = run.select(F.col("id").alias("model_run_id"))
    class_rows = tables.class_metrics.join(of_run, "model_run_id", "left_semi")
    counted = class_rows.agg(F.sum("n_items")).scalar()
    # An aggregate without keys has one row even over no run; over one run it is that run.
    def value(column):
        return F.coalesce(F.max(column), F.lit(0.0))

    overall = run.agg(
        value("wmape").alias("wmape"), value(or_volume()).alias("accuracy"), value("r2").alias("r2"), value("mae").alias("mae"),
        value("periods_within_20pct").alias("periods_within_20pct"), value("periods_within_50pct").alias("periods_within_50pct"),
    ).select(
        F.lit("global").alias("kind"), none.cast("string").alias("name"), F.coalesce(counted, F.lit(0)).alias("n_items"),
        "wmape", "accuracy", "r2", "mae", "periods_within_20pct", "periods_within_50pct",
        none.cast("double").alias("quantity_sold"), none.cast("double").alias("predicted"),
    )
    classes = class_rows.select(
        F.lit("class").alias("kind"), F.col("abc_class").alias("name"), "n_items", "wmape",
        or_volume().alias("accuracy"),
    )
    items = tables.top_items.join(of_run, "model_run_id", "left_semi").select(
        F.lit("item").alias("kind"), F.col("item_name").alias("name"),
        F.col("accuracy_pct").alias("accuracy"), "quantity_sold", "predicted",
    )
    return overall.unionByName(classes, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)


def run_volumes(tables: RunTables, family: str, item: str = "item_name") -> DataFrame:
    """Forecast rows of a family's latest active run, as Item and Quantity_Sold."""
    of_run = latest_active_run(tables.runs, family).select(F.col("id").alias("model_run_id"))
    return tables.forecasts.join(of_run, "model_run_id", "left_semi").select(
        F.col(item).alias("Item"), F.col("quantity_predicted").alias("Quantity_Sold")
    )


def resolve_items(forecast: DataFrame, items: DataFrame, model_run_id: int, quantity: str = "Predicted") -> DataFrame:
    """Forecast rows with item ids; names that are not in the dimension are dropped."""
    ids = items.select(F.col("id").alias("item_id"), F.col("name").alias("Item"))
    return forecast.join(ids, "Item").select(
        F.lit(model_run_id).alias("model_run_id"), "item_id",
        F.col("Date").cast("date").alias("date"),
        F.col(quantity).cast("double").alias("quantity_predicted"),
    )


def record_run(
    tables: RunTables, run: DataFrame, class_metrics: DataFrame, top_items: DataFrame, forecasts: DataFrame,
    item_models: DataFrame | None = None,
) -> RunTables:
    """Registry after a retrain: earlier runs of the same family go inactive, the new rows join.

    ``run`` is one row with its id; the children carry ``model_run_id``.
    """
    listed = [x for x in (tables.item_models, item_models) if x is not None]
    family = run.agg(F.max("model_type")).scalar()
    retired = tables.runs.withColumn(
        "is_active", F.when(F.col("model_type") == family, F.lit(False)).otherwise(F.col("is_active"))
    )
    return RunTables(
        runs=retired.unionByName(run, allowMissingColumns=True),
        class_metrics=tables.class_metrics.unionByName(class_metrics, allowMissingColumns=True),
        top_items=tables.top_items.unionByName(top_items, allowMissingColumns=True),
        forecasts=tables.forecasts.unionByName(forecasts, allowMissingColumns=True),
        item_models=reduce(DataFrame.unionByName, listed) if listed else None,
    )


def next_run_id(runs: DataFrame) -> DataFrame:
    return runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def cleanup(tables: RunTables) -> tuple[RunTables, DataFrame]:
    """Tables without inactive runs and their children, and how many rows each lost."""
    inactive = tables.runs.where(~F.col("is_active")).select(F.col("id").alias("model_run_id"))
    kept = RunTables(
        runs=tables.runs.where(F.col("is_active")),
        **{
            name: child.join(inactive, "model_run_id", "left_anti")
            for name, child in tables.children().items()
        },
    )

    def lost(child: DataFrame):
        return child.join(inactive, "model_run_id", "left_semi").agg(F.count(F.lit(1))).scalar()

    counts = inactive.agg(F.count(F.lit(1)).alias("deleted_runs")).select(
        "deleted_runs",
        *[lost(child).alias(f"deleted_{name}") for name, child in tables.children().items()],
    )
    return kept, counts


def persisted_abc(classified: DataFrame, items: DataFrame) -> DataFrame:
    """ABC classes by item id with the time they were computed."""
    ids = items.select(F.col("id").alias("item_id"), F.col("name").alias("Item"))
    return classified.join(ids, "Item").select(
        "item_id",
        F.col("Vol").alias("total_volume"),
        F.col("Cum").alias("cumulative_volume"),
        F.col("Pct").alias("cumulative_pct"),
        F.col("Class").alias("abc_class"),
        F.current_timestamp().alias("computed_at"),
    )

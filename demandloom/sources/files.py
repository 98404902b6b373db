"""CSV, Parquet, JSON and JDBC in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandloom import schemas
from demandloom.session import materialise

# The stage tables and their file schemas.
STAGE_TABLES: dict[str, StructType] = {
    "merged_sales": schemas.RECEIPTS,
    "cleaned_sales": schemas.RECEIPTS,
    "daily_item_sales": schemas.DAILY_ITEM_SALES,
    "daily_category_sales": schemas.DAILY_CATEGORY_SALES,
    "daily_total_sales": schemas.DAILY_TOTAL_SALES,
    "forecasts": schemas.FORECAST_FILE,
    "menu_bom": schemas.MENU_BOM,
    "condiment_bom": schemas.CONDIMENT_BOM,
}


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",") -> DataFrame:
    """Headered CSV, columns by name. Without a schema every column stays text; nothing is inferred.

    With one, the named columns come in its order and types; a cell that isn't of the type is NULL.
    """
    found = strip_headers(spark.read.option("header", True).option("sep", sep).csv(path))
    return found if schema is None else typed(found, schema)


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns, by name; a table that lacks one is refused."""
    absent = [field.name for field in schema if field.name not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are not in {df.columns}")
    return df.select(*[F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name) for field in schema])


def read_table(spark: SparkSession, name: str, folder: str, fmt: str = "parquet") -> DataFrame:
    """One of the named stage tables."""
    path = f"{folder}/{name}"
    if fmt == "csv":
        return read_csv(spark, path, STAGE_TABLES[name])
    return typed(spark.read.parquet(path), STAGE_TABLES[name])


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
) -> DataFrame:
    """A relational table; with a numeric key it is read in parallel ranges."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=dict(properties))
    low, high = bounds
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=low, upperBound=high,
        numPartitions=partitions, properties=dict(properties),
    )


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str], mode: str = "append") -> None:
    df.write.option("batchsize", 5000).jdbc(url, table, mode=mode, properties=dict(properties))


def write_table(df: DataFrame, name: str, folder: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Overwrite one stage table; CSV carries a header row."""
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def reload_all(tables: Mapping[str, DataFrame], folder: str, order: Sequence[str]) -> dict[str, str]:
    """Bulk reload: every table replaced, parents before children.

    All tables are computed before the first is replaced, so they may come from the same folder.
    """
    ready = {name: materialise(tables[name]) for name in order}
    return {name: write_table(df, name, folder) for name, df in ready.items()}


def pick_column(df: DataFrame, *candidates: str) -> str:
    """First candidate the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} in {df.columns}")


def read_item_demand(df: DataFrame) -> DataFrame:
    """Date, Item, Quantity_Sold from a sales table with either header dialect."""
    df = strip_headers(df)
    return df.select(
        F.col(pick_column(df, "Date_Only", "Date")).cast("date").alias("Date"),
        "Item",
        F.col(pick_column(df, "Quantity", "Quantity_Sold")).cast("double").alias("Quantity_Sold"),
    )


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_there(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions under a folder, in any file system."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    children = [status.getPath() for status in files.listStatus(place)]
    done = [c for c in children if c.getName().startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(c, "_SUCCESS"))]
    return sorted(int(c.getName()[2:]) for c in done)


def write_version(df: DataFrame, path: str) -> str:
    """A small table as the next version; readers see it once it is complete. It may be read from ``path``."""
    spark = df.sparkSession
    target = f"{path}/v={max(_versions(spark, path), default=0) + 1}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version, if there is one."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None

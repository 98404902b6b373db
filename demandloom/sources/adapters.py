"""The given star-schema tables seen as a shop's data.

Only the columns a caller uses survive column pruning, and party tables are joined on request. No
join carries a broadcast hint: Catalyst and AQE choose by measured size, so the same plan holds when
``part`` or ``orders`` outgrow memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom import session
from demandloom.functions.dates import TradingCalendar

# The trading calendar used over the given tables (1995-2001).
STAR_CALENDAR = TradingCalendar(
    event_date="1999-05-01",
    holidays=tuple(f"{y}-{d}" for y in range(1995, 2002) for d in ("01-01", "05-01", "12-25")),
    fasting=tuple((f"{y}-02-28", f"{y}-04-10") for y in range(1995, 2002)),
)

# Forecaster family by order priority digit.
FAMILY_BY_PRIORITY = {"1": "boosted", "2": "forest", "3": "arima", "4": "additive", "5": "boosted"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sale_lines(spark: SparkSession, folder: str, party: bool = False) -> DataFrame:
    """Receipt lines: lineitem with its order and part, and supplier and customer on request."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    part = table(spark, folder, "part")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        part, lines.l_partkey == part.p_partkey
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    columns = [
        F.col("o_orderdate").cast("date").alias("Date"),
        F.col("l_orderkey").alias("Receipt number"),
        F.col("l_linenumber").alias("Line"),
        F.when(F.col("l_returnflag") == "R", "Refund").otherwise("Sale").alias("Receipt type"),
        F.col("p_type").alias("Category"),
        F.col("p_name").alias("Item"),
        F.col("p_brand").alias("Variant"),
        F.when(F.col("p_size") % 3 == 0, "Hot").when(F.col("p_size") % 3 == 1, "Ice").alias("Modifiers applied"),
        F.col("l_quantity").alias("Quantity"),
        F.col("l_extendedprice").alias("Gross sales"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("Discounts"),
        net.alias("Net sales"),
        (net * F.col("l_tax")).alias("Taxes"),
        F.col("o_orderpriority").alias("Dining option"),
        F.col("o_orderstatus").alias("Status"),
    ]
    if party:
        supplier = table(spark, folder, "supplier")
        customer = table(spark, folder, "customer")
        joined = joined.join(supplier, F.col("l_suppkey") == supplier.s_suppkey).join(
            customer, F.col("o_custkey") == customer.c_custkey
        )
        columns += [F.col("s_name").alias("Store"), F.col("c_name").alias("Customer name")]
    return joined.select(*columns)


def demand_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Date, Item and the three measures, for callers that only sum them.

    The catalogue meets the lines after they are summed by date and part, so a part with a third of all
    lines reaches the join as one row per day.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("Item"))
    dated = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderdate").cast("date").alias("Date"), "l_partkey",
        F.col("l_quantity").alias("Quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Net sales"),
        F.col("l_extendedprice").alias("Gross sales"),
    ).where(F.col("Quantity") > 0)
    summed = dated.groupBy("Date", "l_partkey").agg(*[F.sum(c).alias(c) for c in ("Quantity", "Net sales", "Gross sales")])
    return summed.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def item_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """Item and Quantity_Sold, a row per part: for totals over all dates, which don't need the orders.

    Every line has an order.
    """
    sold = table(spark, folder, "lineitem").where(F.col("l_quantity") > 0).groupBy("l_partkey").agg(F.sum("l_quantity").alias("Quantity_Sold"))
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("Item"))
    return sold.join(part, F.col("l_partkey") == F.col("p_partkey")).select("Item", "Quantity_Sold")


def basket_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Receipt, item and category of every line; orders add nothing to a basket."""
    lines = table(spark, folder, "lineitem")
    part = table(spark, folder, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("Receipt number"), F.col("p_name").alias("Item"), F.col("p_type").alias("Category"))


def event_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamped sales from the event stream table."""
    return table(spark, folder, "events").select(
        F.col("ts").alias("Date"), F.col("event_type").alias("Item"), F.col("value").alias("Quantity")
    )


def item_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Item to category: the type of the item's lowest part key."""
    return (
        table(spark, folder, "part")
        .groupBy(F.col("p_name").alias("Item"))
        .agg(F.min_by("p_type", "p_partkey").alias("Category"))
    )


def menu_bom(spark: SparkSession, folder: str) -> DataFrame:
    """Item to ingredient: part names made of brands."""
    return (
        table(spark, folder, "part")
        .groupBy(F.col("p_name").alias("Item"), F.col("p_brand").alias("Bahan"))
        .agg((F.sum("p_size") / 100.0).alias("Qty"), F.min("p_type").alias("Tipe"))
        .select("Tipe", "Item", "Bahan", "Qty", F.lit("gr").alias("Unit"))
    )


def condiment_bom(spark: SparkSession, folder: str) -> DataFrame:
    """Two levels: low brands are made of types, three of the types are made of regions."""
    part = table(spark, folder, "part")
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    lines = (
        part.where(number <= 15)
        .groupBy("p_brand", "p_type")
        .agg(F.sum("p_size").cast("double").alias("q"))
    )
    batch = lines.groupBy("p_brand").agg(F.sum("q").alias("batch"))
    first = lines.join(batch, "p_brand").select(
        F.col("p_brand").alias("Condiment"), F.col("batch").alias("Condiment_Qty"),
        F.col("p_type").alias("Sub_Ingredient"), F.col("q").alias("Qty_per_condiment_unit"),
    )
    # Types that are condiments themselves, each made of every region.
    second = (
        table(spark, folder, "region")
        .withColumn("Condiment", F.explode(F.array(*map(F.lit, ("ECONOMY", "PROMO", "SMALL")))))
        .select(
            "Condiment", F.lit(10.0).alias("Condiment_Qty"), F.col("r_name").alias("Sub_Ingredient"),
            (F.col("r_regionkey") + 1).cast("double").alias("Qty_per_condiment_unit"),
        )
    )
    return first.unionByName(second).select(
        "Condiment", "Condiment_Qty", F.lit("gr").alias("Condiment_Unit"), "Sub_Ingredient",
        "Qty_per_condiment_unit", F.lit("gr").alias("Sub_Unit"),
    )


def active_menu(spark: SparkSession, folder: str) -> DataFrame:
    """Menu spelling of the items on sale.

    ``old …`` is no longer sold; ``new …`` is sold hot and iced, ``small …`` hot, ``large …`` iced;
    the rest under its plain name.
    """
    name = F.initcap("p_name")
    spelled = (
        F.when(F.col("p_name").startswith("new "),
               F.concat(name, F.when(F.col("p_size") % 3 == 0, " Hot").otherwise(" Ice")))
        .when(F.col("p_name").startswith("small "), F.concat(name, F.lit(" Hot")))
        .when(F.col("p_name").startswith("large "), F.concat(name, F.lit(" Ice")))
        .otherwise(name)
    )
    return (
        table(spark, folder, "part")
        .where(~F.col("p_name").startswith("old "))
        .groupBy(spelled.alias("Item"))
        .agg(F.min_by("p_type", "p_partkey").alias("Tipe"))
    )


def recipe_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The normalised recipe schema: products, variants, materials, condiments and their lines."""
    part = table(spark, folder, "part")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    products = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        (F.col("p_size") > 5).alias("is_active"),
    )
    variants = part.where(F.col("p_size") % 2 == 0).select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") % 4 == 0, "default").otherwise(F.col("p_type")).alias("name"),
        (F.col("p_size") % 10 != 0).alias("is_active"),
    )
    materials = supplier.select(
        F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).cast("long").alias("unit_id"),
        (F.col("s_acctbal") > 1000).alias("is_active"),
    )
    condiments = nation.select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).cast("double").alias("batch_quantity"),
        F.col("n_regionkey").cast("long").alias("unit_id"),
    )
    units = region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("code"))
    lines = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_tax").alias("tax")
    )
    by_condiment = F.col("l_suppkey") % 4 == 0
    recipe_lines = lines.select(
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey")).alias("variant_id"),
        F.when(~by_condiment, F.col("l_suppkey")).alias("material_id"),
        F.when(by_condiment, F.col("l_suppkey") % 25).alias("condiment_id"),
        (F.round(F.col("tax") * 100, 0) + 1.0).alias("quantity"),
    )
    condiment_lines = supplier.select(
        F.col("s_nationkey").cast("long").alias("condiment_id"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey")).cast("long").alias("material_id"),
        F.when(F.col("s_suppkey") % 5 == 0, (F.col("s_nationkey") + 1) % 25).cast("long").alias("child_condiment_id"),
        (F.col("s_suppkey") % 7 + 1).cast("double").alias("quantity"),
    )
    links = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") % 5 != 0, F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")).alias("category_id"),
    )
    categories = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return {
        "products": products, "variants": variants, "materials": materials,
        "condiments": condiments, "units": units, "recipe_lines": recipe_lines,
        "condiment_lines": condiment_lines, "category_links": links, "categories": categories,
    }


def run_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A model-run registry: one run per order priority and year, its forecasts and metrics."""
    orders = table(spark, folder, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    year = F.year("o_orderdate")
    run_id = ((year - 1995) * 5 + digit.cast("int")).alias("model_run_id")
    family = F.create_map(*[F.lit(v) for pair in FAMILY_BY_PRIORITY.items() for v in pair])
    runs = (
        orders.groupBy(run_id, digit.alias("digit"), year.alias("year"))
        .agg(
            F.max("o_orderdate").cast("timestamp").alias("trained_at"),
            F.count(F.lit(1)).alias("n_records"),
            F.min("o_orderdate").cast("date").alias("date_range_start"),
            F.max("o_orderdate").cast("date").alias("date_range_end"),
            F.round(F.avg("o_totalprice") / 1e6, 4).alias("mean_price"),
        )
        .select(
            F.col("model_run_id").alias("id"), family[F.col("digit")].alias("model_type"), "trained_at",
            "n_records", "date_range_start", "date_range_end",
            F.when(F.col("year") % 2 == 0, F.col("mean_price")).alias("r2"),
            (F.col("mean_price") * 100).alias("wmape"), F.col("mean_price").alias("mae"),
            F.when(F.col("digit") == "2", F.lit(0.0)).otherwise(F.col("mean_price") * 90).alias("median_period_accuracy"),
            (F.col("mean_price") * 80).alias("volume_accuracy"),
            (F.col("mean_price") * 50).alias("periods_within_20pct"),
            F.when(F.col("year") != 2001, F.col("mean_price") * 70).alias("periods_within_50pct"),
            (F.col("year") >= 2000).alias("is_active"),
        )
    )
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    forecasts = lines.groupBy(
        run_id, F.col("p_name").alias("item_name"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(F.sum("l_quantity").alias("quantity_predicted"))
    classes = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    class_metrics = lines.groupBy(run_id, classes.alias("abc_class")).agg(
        F.count_distinct("p_name").alias("n_items"),
        F.round(F.avg("l_discount") * 100, 4).alias("wmape"),
        F.round(F.avg("l_tax") * 1000, 4).alias("volume_accuracy"),
        F.when(F.max("l_orderkey") % 2 == 0, F.round(F.avg("l_tax") * 1200, 4)).alias("median_period_accuracy"),
    )
    top_items = lines.groupBy(run_id, F.col("p_name").alias("item_name")).agg(
        F.sum("l_quantity").alias("quantity_sold"),
        F.sum(F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 0)).alias("predicted"),
    ).withColumn(
        "accuracy_pct",
        F.round(100.0 * (1 - F.abs(F.col("predicted") - F.col("quantity_sold")) / F.col("quantity_sold")), 4),
    )
    return {
        "runs": runs, "forecasts": forecasts, "class_metrics": class_metrics, "top_items": top_items,
    }

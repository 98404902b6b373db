"""Queries over daily aggregates, paging and the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.numeric import rounded
from demandloom.operators import aggregates, serving
from demandloom.plans import views
from demandloom.plans.oracle_views import VIEWS, with_
from demandloom.plans.queries_cleaning import ITEM_DIM_SQL, TEMPORAL_SQL
from demandloom.operators.dimensions import item_facts
from demandloom.sources import adapters
from demandloom.session import materialise

QUERIES, ORACLES = {}, {}


def _rounded_sums(df):
    return df.withColumns({
        "Quantity": rounded("Quantity", 4), "Net sales": rounded(F.col("`Net sales`"), 4),
        "Gross sales": rounded(F.col("`Gross sales`"), 4), "MonthProgress": rounded("MonthProgress", 6),
    })


_SUMS_SQL = 'round(sum(q), 4) AS "Quantity", round(sum(net), 4) AS "Net sales", round(sum(gross), 4) AS "Gross sales"'


def daily_item_sales(spark, sf):
    return _rounded_sums(views.daily_items(spark, sf))


ORACLES["daily_item_sales"] = with_("sales", "cats", "daily", body=f"""
SELECT "Date" AS Date_Only, Item, Category, round(q, 4) AS "Quantity", round(net, 4) AS "Net sales", round(gross, 4) AS "Gross sales",
 {TEMPORAL_SQL.format('"Date"')} FROM daily""")


def daily_category_sales(spark, sf):
    return _rounded_sums(aggregates.daily_category_sales(views.daily_items(spark, sf)))


ORACLES["daily_category_sales"] = with_("sales", "cats", "daily", body=f"""
SELECT "Date" AS Date_Only, Category, {_SUMS_SQL}, count(*) AS UniqueItemCount, {TEMPORAL_SQL.format('"Date"')} FROM daily GROUP BY "Date", Category""")


def daily_total_sales(spark, sf):
    return _rounded_sums(aggregates.daily_total_sales(views.daily_items(spark, sf)))


ORACLES["daily_total_sales"] = with_("sales", "cats", "daily", body=f"""
SELECT "Date" AS Date_Only, {_SUMS_SQL}, count(*) AS UniqueItemCount, count(DISTINCT Category) AS UniqueCategoryCount, {TEMPORAL_SQL.format('"Date"')} FROM daily GROUP BY "Date" """)


def daily_item_qty(spark, sf):
    return aggregates.daily_item_quantity(adapters.sale_lines(spark, sf))


ORACLES["daily_item_qty"] = with_("sales", body="""
SELECT "Date", Item, sum(q) AS Quantity_Sold FROM sales WHERE NOT starts_with(lower(Item), 'add') AND NOT contains(lower(Item), 'cheese cake') GROUP BY 1, 2""")


def period_sales(spark, sf):
    found = aggregates.period_sales(adapters.event_sales(spark, sf))
    return found.withColumn("Quantity_Sold", rounded("Quantity_Sold", 4))


_PERIODS = """SELECT CAST(ts AS DATE) AS "Date", event_type AS Item, CASE WHEN hour(ts) < 13 THEN '08:00-13:00' WHEN hour(ts) < 18 THEN '13:00-18:00' ELSE '18:00-24:00' END AS Time_Period,
 sum(value) AS q FROM events WHERE hour(ts) >= 8 GROUP BY 1, 2, 3"""
ORACLES["period_sales"] = f'SELECT "Date", Item, Time_Period, round(q, 4) AS Quantity_Sold FROM ({_PERIODS})'


def period_summary(spark, sf):
    found = aggregates.period_summary(aggregates.period_sales(adapters.event_sales(spark, sf)))
    return found.withColumn("Total_Quantity_Sold", rounded("Total_Quantity_Sold", 4))


ORACLES["period_summary"] = f"""SELECT Time_Period, round(sum(q), 4) AS Total_Quantity_Sold, count(DISTINCT "Date") AS Unique_Dates, count(DISTINCT Item) AS Unique_Items
FROM ({_PERIODS}) GROUP BY 1"""


def top_items(spark, sf):
    return aggregates.top_items(adapters.item_volumes(spark, sf), 20, "Quantity_Sold")


ORACLES["top_items"] = with_("vol", body="SELECT Item, vol AS total_quantity FROM vol ORDER BY vol DESC, Item LIMIT 20").replace(
    "WITH vol", f"WITH sales AS ({VIEWS['sales']}), vol")


def transformation_metadata(spark, sf):
    """Flattened: the category list and the top items as text."""
    lines = adapters.sale_lines(spark, sf)
    cats = adapters.item_categories(spark, sf)
    daily = materialise(views.daily_items(spark, sf).select("Date_Only", "Item", "Quantity"))
    found = aggregates.transformation_metadata(lines, daily, cats)
    entries = F.transform(F.array_sort(F.map_entries("top_items")),
                          lambda e: F.concat(e.key, F.lit("="), e.value.cast("long").cast("string")))
    return found.withColumns({
        "categories": F.array_join("categories", ","), "top_items": F.array_join(entries, ",")})


ORACLES["transformation_metadata"] = with_("sales", "cats", "daily", body="""
, top AS (SELECT Item, sum(q) AS v FROM daily GROUP BY 1 ORDER BY v DESC, Item LIMIT 20)
SELECT (SELECT count(*) FROM sales) AS original_transactions, (SELECT count(DISTINCT Item) FROM sales) AS unique_items,
 min("Date") AS date_range_start, max("Date") AS date_range_end, count(*) AS daily_records_created,
 date_diff('day', min("Date"), max("Date")) + 1 AS total_days,
 (SELECT string_agg(Category, ',' ORDER BY Category) FROM (SELECT DISTINCT Category FROM cats)) AS categories,
 (SELECT string_agg(Item || '=' || CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY Item) FROM top) AS top_items FROM daily""")


def data_profile(spark, sf):
    found = aggregates.data_profile(materialise(views.daily_quantity(spark, sf)))
    return found.withColumns({c: rounded(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


ORACLES["data_profile"] = with_("sales", "totals", body="""
, d AS (SELECT "Date", Item, sum(q) AS q FROM sales GROUP BY 1, 2)
SELECT d.*, t.* FROM (SELECT count(*) AS row_count, count(*) FILTER ("Date" IS NULL) AS null_date, count(*) FILTER (Item IS NULL) AS null_item,
 count(*) FILTER (q IS NULL) AS null_quantity_sold, min("Date") AS first_date, max("Date") AS last_date, count(DISTINCT Item) AS unique_items, sum(q) AS total_quantity FROM d) d,
(SELECT count(*) AS days, round(avg(q), 4) AS mean, round(stddev_samp(q), 4) AS std, min(q) AS "min", round(quantile_cont(q, 0.25), 4) AS q25,
 round(quantile_cont(q, 0.5), 4) AS q50, round(quantile_cont(q, 0.75), 4) AS q75, max(q) AS "max" FROM totals) t""")


def seasonality_profile(spark, sf):
    found = aggregates.seasonality_profile(views.totals(spark, sf))
    return found.select("kind", "position", "label", rounded("mean_quantity", 4).alias("mean_quantity"))


ORACLES["seasonality_profile"] = with_("sales", "totals", body="""
SELECT 'weekday' AS kind, isodow("Date") - 1 AS position, dayname("Date") AS label, round(avg(q), 4) AS mean_quantity FROM totals GROUP BY 2, 3
UNION ALL SELECT 'month', month("Date"), CAST(month("Date") AS VARCHAR), round(avg(q), 4) FROM totals GROUP BY 2, 3""")


def category_list(spark, sf):
    return serving.distinct_names(views.daily_items(spark, sf), "Category")


ORACLES["category_list"] = with_("sales", "cats", "daily", body="SELECT DISTINCT Category FROM daily")


def _facts(spark, sf):
    items = views.item_dim(spark, sf).select("id", "name")
    return item_facts(views.demand(spark, sf), items), items


_SPAN = ("1996-01-01", "1997-12-31")
_FACTS_SQL = f"""WITH cats AS ({VIEWS['cats']}), sales AS ({VIEWS['sales']}), {ITEM_DIM_SQL},
facts AS (SELECT "Date" AS date, d.id AS item_id, d.name AS item, sum(q) AS quantity_sold FROM sales JOIN dimitems d ON d.name = Item GROUP BY 1, 2, 3)"""


def daily_sales_page(spark, sf):
    facts, items = _facts(spark, sf)
    return serving.daily_sales_page(facts, items, start=_SPAN[0], end=_SPAN[1], page=3, size=100)


ORACLES["daily_sales_page"] = _FACTS_SQL + f"""
SELECT date, item, quantity_sold FROM facts WHERE date BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}' ORDER BY date, item LIMIT 100 OFFSET 200"""


def daily_sales_count(spark, sf):
    facts, items = _facts(spark, sf)
    return serving.row_count(serving.daily_sales(facts, items, item="hot ring", start=_SPAN[0], end=_SPAN[1]))


ORACLES["daily_sales_count"] = _FACTS_SQL + f"""
SELECT count(*) AS total FROM facts WHERE item = 'hot ring' AND date BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}'"""


def _stored_categories(spark, sf):
    return aggregates.daily_category_sales(views.daily_items(spark, sf)).select(
        F.col("Date_Only").alias("date"), F.col("Category").alias("category"), F.col("Quantity").alias("quantity"),
        rounded(F.col("`Net sales`"), 4).alias("net_sales"), rounded(F.col("`Gross sales`"), 4).alias("gross_sales"),
        F.col("UniqueItemCount").alias("unique_items"))


def daily_category_page(spark, sf):
    return serving.category_page(_stored_categories(spark, sf), "SMALL", *_SPAN, page=2, size=50)


ORACLES["daily_category_page"] = with_("sales", "cats", "daily", body=f"""
SELECT "Date" AS date, Category AS category, sum(q) AS quantity, round(sum(net), 4) AS net_sales, round(sum(gross), 4) AS gross_sales, count(*) AS unique_items
FROM daily WHERE Category = 'SMALL' AND "Date" BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50 OFFSET 50""")


def daily_total_page(spark, sf):
    stored = aggregates.daily_total_sales(views.daily_items(spark, sf)).select(
        F.col("Date_Only").alias("date"), F.col("Quantity").alias("quantity"),
        rounded(F.col("`Net sales`"), 4).alias("net_sales"), rounded(F.col("`Gross sales`"), 4).alias("gross_sales"),
        F.col("UniqueItemCount").alias("unique_items"))
    return serving.total_page(stored, *_SPAN, page=2, size=100)


ORACLES["daily_total_page"] = with_("sales", "cats", "daily", body=f"""
SELECT "Date" AS date, sum(q) AS quantity, round(sum(net), 4) AS net_sales, round(sum(gross), 4) AS gross_sales, count(*) AS unique_items
FROM daily WHERE "Date" BETWEEN DATE '{_SPAN[0]}' AND DATE '{_SPAN[1]}' GROUP BY 1 ORDER BY 1 LIMIT 100 OFFSET 100""")


def history_for_items(spark, sf):
    return serving.history_for_items(views.daily_quantity(spark, sf), ["hot ring", "cold ring", "old rod", "absent"])


ORACLES["history_for_items"] = with_("sales", body="""
SELECT "Date", Item, sum(q) AS Quantity_Sold FROM sales WHERE Item IN ('hot ring', 'cold ring', 'old rod', 'absent') GROUP BY 1, 2""")

QUERIES |= {name: globals()[name] for name in ORACLES}

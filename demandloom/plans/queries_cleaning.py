"""Queries over receipt lines: parsing, name standardisation, discontinued items, loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import dates, numeric, text
from demandloom.operators import aggregates, cleaning, dimensions, serving
from demandloom.plans import views
from demandloom.plans.oracle_views import VIEWS, initcap, with_
from demandloom.sources import adapters
from demandloom.sources.adapters import STAR_CALENDAR, sale_lines, table
from demandloom.operators.features import add_calendar

QUERIES, ORACLES = {}, {}


def _key():
    return F.col("Receipt number").alias("receipt"), F.col("Line").alias("line")


# Renames used over the given part names.
STAR_RENAMES = {
    "red ring": "Blue Ring", "RED ROD": "Blue Rod", "old gizmo": "Cold Gizmo", "old widget": "Cold Widget",
}
STAR_PACKAGES = {
    "hot plate": (("hot rod", 1.0), ("hot ring", 2.0)),
    "cold plate": (("cold rod", 1.0), ("cold ring", 0.5), ("cold bolt", 3.0)),
}
STAR_VALUES = {
    "Receipt type": {"Refund": "Return"},
    "Dining option": {"1-URGENT": "Dine in", "5-LOW": "Takeaway"},
    "Status": {"O": "Open", "F": "Closed"},
}


def translate_values(spark, sf):
    lines = cleaning.translate_values(sale_lines(spark, sf), STAR_VALUES)
    return lines.select(*_key(), F.col("Receipt type").alias("receipt_type"),
                        F.col("Dining option").alias("dining_option"), F.col("Status").alias("status"))


ORACLES["translate_values"] = with_("sales", body="""
SELECT receipt, line, CASE receipt_type WHEN 'Refund' THEN 'Return' ELSE receipt_type END AS receipt_type,
 CASE dining WHEN '1-URGENT' THEN 'Dine in' WHEN '5-LOW' THEN 'Takeaway' ELSE dining END AS dining_option,
 CASE status WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE status END AS status FROM sales""")


def parse_dates(spark, sf):
    """Order times written in five styles, one of them unreadable, and read back."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    moment = F.col("o_orderdate") + F.make_dt_interval(
        hours=(key % 24).cast("int"), mins=(key % 60).cast("int"))
    written = F.when(key % 7 == 0, F.lit("junk"))
    for i, fmt in enumerate(("dd/MM/yy HH.mm", "d/M/yy H:mm", "M/d/yy h:mm a", "MM/dd/yyyy hh:mm a")):
        written = written.when(key % 5 == i, F.date_format(moment, fmt))
    written = written.otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    return orders.select("o_orderkey", written.alias("t")).select(
        "o_orderkey", "t", dates.parse_receipt_time(F.col("t")).cast("timestamp_ntz").alias("parsed"))


ORACLES["parse_dates"] = """
WITH m AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS ts FROM orders),
w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'junk' ELSE CASE o_orderkey % 5
  WHEN 0 THEN strftime(ts, '%d/%m/%y %H.%M') WHEN 1 THEN strftime(ts, '%-d/%-m/%y %-H:%M')
  WHEN 2 THEN strftime(ts, '%-m/%-d/%y %-I:%M %p') WHEN 3 THEN strftime(ts, '%m/%d/%Y %I:%M %p')
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END END AS t FROM m)
SELECT o_orderkey, t, coalesce(try_strptime(t, '%d/%m/%y %H.%M'), try_strptime(t, '%d/%m/%y %H:%M'),
  try_strptime(t, '%m/%d/%y %I:%M %p'), try_strptime(t, '%m/%d/%Y %I:%M %p'), try_cast(t AS TIMESTAMP)) AS parsed FROM w"""


def _messy_number():
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    style = F.col("l_linenumber") % 4
    return (F.when(style == 0, F.concat(F.lit("-"), price))
            .when(style == 1, F.concat(F.lit("Rp "), price))
            .when(style == 2, F.replace(price, F.lit("."), F.lit(",")))
            .otherwise(F.concat(price, F.lit(".5"))))


_MESSY = """CASE l_linenumber % 4 WHEN 0 THEN '-' || p WHEN 1 THEN 'Rp ' || p WHEN 2 THEN replace(p, '.', ',') ELSE p || '.5' END"""
_MESSY_FROM = "(SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM lineitem)"


def numeric_scrub(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("receipt"), F.col("l_linenumber").alias("line"), _messy_number().alias("t")
    ).select("*", numeric.scrub_number(F.col("t")).alias("value"))


ORACLES["numeric_scrub"] = f"""SELECT receipt, line, t, try_cast(regexp_replace(t, '[^0-9.]', '', 'g') AS DOUBLE) AS value
FROM (SELECT l_orderkey AS receipt, l_linenumber AS line, {_MESSY} AS t FROM {_MESSY_FROM})"""


def decimal_comma(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("receipt"), F.col("l_linenumber").alias("line"), _messy_number().alias("t")
    ).select("*", numeric.decimal_comma(F.col("t")).alias("value"))


ORACLES["decimal_comma"] = f"""SELECT receipt, line, t, try_cast(replace(trim(t), ',', '.') AS DOUBLE) AS value
FROM (SELECT l_orderkey AS receipt, l_linenumber AS line, {_MESSY} AS t FROM {_MESSY_FROM})"""


def apply_modifiers(spark, sf):
    return cleaning.apply_modifiers(sale_lines(spark, sf)).select(*_key(), "Item")


_MODIFIED = """CASE WHEN modifier IS NOT NULL AND NOT (lower(Item) LIKE '% hot' OR lower(Item) LIKE '% ice')
 THEN trim(Item) || ' ' || modifier ELSE Item END"""
ORACLES["apply_modifiers"] = with_("sales", body=f"SELECT receipt, line, {_MODIFIED} AS Item FROM sales")


def rename_items(spark, sf):
    return cleaning.rename_items(sale_lines(spark, sf), STAR_RENAMES).select(*_key(), "Item")


_RENAMED = """CASE lower(Item) WHEN 'red ring' THEN 'Blue Ring' WHEN 'red rod' THEN 'Blue Rod'
 WHEN 'old gizmo' THEN 'Cold Gizmo' WHEN 'old widget' THEN 'Cold Widget' ELSE Item END"""
ORACLES["rename_items"] = with_("sales", body=f"SELECT receipt, line, {_RENAMED} AS Item FROM sales")


def case_to_bom(spark, sf):
    return cleaning.case_to_menu(sale_lines(spark, sf), adapters.active_menu(spark, sf)).select(*_key(), "Item")


ORACLES["case_to_bom"] = with_("sales", "menu", body="""
SELECT receipt, line, coalesce(m.Item, s.Item) AS Item FROM sales s LEFT JOIN menu m ON lower(m.Item) = lower(trim(s.Item))""")


def pattern_collapse(spark, sf):
    return sale_lines(spark, sf).select(*_key(), text.collapse_pattern(F.col("Item"), "gizmo", "Gizmo").alias("Item"))


ORACLES["pattern_collapse"] = with_("sales", body="""
SELECT receipt, line, CASE WHEN contains(lower(Item), 'gizmo') THEN 'Gizmo' ELSE Item END AS Item FROM sales""")


def suffix_match(spark, sf):
    return cleaning.suffix_match(sale_lines(spark, sf), adapters.active_menu(spark, sf)).select(*_key(), "Item")


_SUFFIXED = """SELECT s.receipt, s.line, s.q, s."Date", CASE WHEN b.Item IS NOT NULL THEN s.Item ELSE coalesce(h.Item, i.Item, s.Item) END AS Item
 FROM {0} s LEFT JOIN menu b ON lower(b.Item) = lower(trim(s.Item))
 LEFT JOIN menu h ON lower(h.Item) = lower(trim(s.Item)) || ' hot' LEFT JOIN menu i ON lower(i.Item) = lower(trim(s.Item)) || ' ice'"""
ORACLES["suffix_match"] = with_("sales", "menu", body=f"SELECT receipt, line, Item FROM ({_SUFFIXED.format('sales')})")


def standardise_names(spark, sf):
    lines = cleaning.standardise_names(
        sale_lines(spark, sf), adapters.active_menu(spark, sf), STAR_RENAMES, "gizmo", "Hot Plate")
    return lines.select(*_key(), "Item")


_STANDARD = f"""
WITH sales AS ({VIEWS['sales']}), menu AS ({VIEWS['menu']}),
s1 AS (SELECT receipt, line, q, "Date", {_MODIFIED} AS Item FROM sales),
s2 AS (SELECT receipt, line, q, "Date", {_RENAMED} AS Item FROM s1),
s3 AS (SELECT receipt, line, q, "Date", coalesce(m.Item, s2.Item) AS Item FROM s2 LEFT JOIN menu m ON lower(m.Item) = lower(trim(s2.Item))),
s4 AS (SELECT receipt, line, q, "Date", CASE WHEN contains(lower(Item), 'gizmo') THEN 'Hot Plate' ELSE Item END AS Item FROM s3),
std AS ({_SUFFIXED.format('s4')})"""
ORACLES["standardise_names"] = _STANDARD + " SELECT receipt, line, Item FROM std"


def regex_consolidate(spark, sf):
    lines = cleaning.consolidate(sale_lines(spark, sf), r"(?i)^HOT (ring|rod)$", "hot part")
    return lines.select(*_key(), "Item")


ORACLES["regex_consolidate"] = with_("sales", body="""
SELECT receipt, line, regexp_replace(trim(Item), '^HOT (ring|rod)$', 'hot part', 'i') AS Item FROM sales""")


def expand_packages(spark, sf):
    return cleaning.expand_packages(sale_lines(spark, sf), STAR_PACKAGES).select(*_key(), "Item", "Quantity")


ORACLES["expand_packages"] = with_("sales", body="""
SELECT receipt, line, coalesce(c.part, Item) AS Item, q * coalesce(c.times, 1.0) AS Quantity FROM sales LEFT JOIN
 (VALUES ('hot plate', 'hot rod', 1.0::DOUBLE), ('hot plate', 'hot ring', 2.0), ('cold plate', 'cold rod', 1.0),
         ('cold plate', 'cold ring', 0.5), ('cold plate', 'cold bolt', 3.0)) c(name, part, times) ON lower(Item) = c.name""")


def merge_sales(spark, sf):
    """Two dialects of receipts made canonical and united; the refunds come from the second file."""
    lines = sale_lines(spark, sf).withColumn("Date", F.date_format("Date", "dd/MM/yy 08.30"))
    first = cleaning.translate_headers(
        lines.where(F.col("Receipt type") == "Sale").select(
            F.col("Date").alias("Tanggal"), F.col("Receipt number").alias("Nomor struk"),
            F.lit("Penjualan").alias("Jenis struk"), F.col("Item").alias("Barang"),
            F.col("Quantity").alias("Kuantitas"), F.lit("x").alias("Ekstra")))
    second = lines.where(F.col("Receipt type") != "Sale").select(
        "Date", "Receipt number", "Receipt type", "Item", F.concat(F.lit("-"), F.col("Quantity")).alias("Quantity"),
        "Status")
    merged = cleaning.union_receipts([
        cleaning.canonical_receipts(cleaning.translate_values(first)), cleaning.canonical_receipts(second)])
    return merged.select(
        F.col("Date").cast("timestamp_ntz").alias("date"), F.col("Receipt number").cast("long").alias("receipt"),
        F.col("Receipt type").alias("receipt_type"), F.col("Item").alias("item"),
        F.col("Quantity").alias("quantity"), F.col("Status").alias("status"), F.col("Gross sales").alias("gross_sales"))


ORACLES["merge_sales"] = with_("sales", body="""
SELECT "Date" + INTERVAL 510 MINUTE AS date, receipt, receipt_type, Item AS item, q AS quantity,
 CASE WHEN receipt_type = 'Refund' THEN status END AS status, CAST(NULL AS DOUBLE) AS gross_sales FROM sales""")


def keep_active_items(spark, sf):
    lines = cleaning.case_to_menu(sale_lines(spark, sf), adapters.active_menu(spark, sf))
    return cleaning.keep_active(lines, adapters.active_menu(spark, sf)).select(*_key(), "Item")


ORACLES["keep_active_items"] = with_("sales", "menu", body="""
SELECT receipt, line, m.Item AS Item FROM sales s JOIN menu m ON lower(m.Item) = lower(trim(s.Item))""")


def discontinued_items(spark, sf):
    lines = cleaning.standardise_names(
        sale_lines(spark, sf), adapters.active_menu(spark, sf), STAR_RENAMES, "gizmo", "Hot Plate")
    return cleaning.discontinued_report(lines, adapters.active_menu(spark, sf))


ORACLES["discontinued_items"] = _STANDARD + """
SELECT Item, sum(q) AS Total_Quantity_Sold, count(*) AS Total_Transactions, min("Date") AS First_Sale_Date, max("Date") AS Last_Sale_Date
FROM std WHERE lower(trim(Item)) NOT IN (SELECT lower(Item) FROM menu) GROUP BY Item"""


def cleaning_stats(spark, sf):
    return cleaning.cleaning_stats(sale_lines(spark, sf), adapters.active_menu(spark, sf), STAR_RENAMES)


ORACLES["cleaning_stats"] = f"""
WITH sales AS ({VIEWS['sales']}), menu AS ({VIEWS['menu']}),
s1 AS (SELECT {_MODIFIED} AS Item FROM sales),
s2 AS (SELECT Item AS was, {_RENAMED} AS Item FROM s1),
s3 AS (SELECT *, lower(trim(Item)) NOT IN (SELECT lower(Item) FROM menu) AS gone FROM s2)
SELECT count(*) AS original_records, CAST(count(*) FILTER (lower(was) IN ('red ring','red rod','old gizmo','old widget')) AS BIGINT) AS renamed_records,
 count(DISTINCT CASE WHEN gone THEN Item END) AS discontinued_items, CAST(count(*) FILTER (gone) AS BIGINT) AS removed_records FROM s3"""


def exclude_prefix(spark, sf):
    return aggregates.excluded_report(sale_lines(spark, sf), "red", "old ")


ORACLES["exclude_prefix"] = with_("sales", body="""
SELECT Item, count(*) AS lines, sum(q) AS quantity FROM sales
WHERE NOT starts_with(lower(trim(Item)), 'red') AND NOT contains(lower(Item), 'old ') GROUP BY Item""")


def temporal_features(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("Date_Only")).distinct()
    found = days.withColumns(dates.temporal_columns(F.col("Date_Only")))
    return found.withColumn("MonthProgress", numeric.rounded("MonthProgress", 6))


TEMPORAL_SQL = """year({0}) AS "Year", month({0}) AS "Month", day({0}) AS "Day", isodow({0}) - 1 AS DayOfWeek,
 dayname({0}) AS DayOfWeekName, weekofyear({0}) AS WeekOfYear, quarter({0}) AS Quarter, dayofyear({0}) AS DayOfYear,
 CAST(isodow({0}) >= 6 AS INTEGER) AS IsWeekend, round(day({0}) / day(last_day({0})), 6) AS MonthProgress"""
ORACLES["temporal_features"] = f"""SELECT Date_Only, {TEMPORAL_SQL.format('Date_Only')}
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS Date_Only FROM orders)"""


def category_lookup(spark, sf):
    menu = adapters.active_menu(spark, sf)
    items = table(spark, sf, "part").select(F.initcap("p_name").alias("Item")).distinct()
    return aggregates.add_category(items, aggregates.last_category(menu))


ORACLES["category_lookup"] = with_("menu", body=f"""
SELECT i.Item, coalesce(m.Tipe, 'Unknown') AS Category FROM (SELECT DISTINCT {initcap('p_name')} AS Item FROM part) i LEFT JOIN menu m USING (Item)""")


def material_names(spark, sf):
    raw = F.when(F.col("p_size") % 10 == 0, F.lit(" skm ")).when(
        F.col("p_size") % 10 == 1, F.lit("Bsj")).when(
        F.col("p_size") % 10 == 2, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(
        F.concat(F.lit("  "), F.upper("p_name")))
    return table(spark, sf, "part").select("p_partkey", text.material_name(raw).alias("material"))


ORACLES["material_names"] = f"""SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'SKM' WHEN 1 THEN 'BSJ' WHEN 2 THEN replace({initcap('p_name')}, ' ', '-') ELSE {initcap('p_name')} END AS material FROM part"""


def calendar_features(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("Date")).distinct()
    found = add_calendar(days, STAR_CALENDAR)
    return found.withColumns({c: numeric.rounded(c, 6) for c in ("Sin_Week", "Cos_Week", "Weeks_Since_Rebrand")})


_DAYS = """(SELECT d AS "Date", min(d) OVER () AS origin FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))"""
_HOLIDAY = "strftime({0}, '%m-%d') IN ('01-01', '05-01', '12-25') AND year({0}) BETWEEN 1995 AND 2001"
CALENDAR_SQL = f"""month({{0}}) AS "Month", weekofyear({{0}}) AS Week, year({{0}}) AS "Year", dayofyear({{0}}) AS DOY, isodow({{0}}) - 1 AS DOW,
 round(sin(2 * pi() * weekofyear({{0}}) / 52), 6) + 0.0 AS Sin_Week, round(cos(2 * pi() * weekofyear({{0}}) / 52), 6) + 0.0 AS Cos_Week,
 CAST(floor(date_diff('day', {{1}}, {{0}}) / 7) AS INTEGER) AS Weeks_Since_Start,
 CAST(day({{0}}) <= 7 OR day({{0}}) >= 25 AS INTEGER) AS Is_Payday_Week, CAST(isodow({{0}}) >= 5 AND day({{0}}) >= 25 AS INTEGER) AS Is_Weekend_Before_Payday,
 CAST({_HOLIDAY} AS INTEGER) AS Is_Holiday,
 CAST(strftime({{0}}, '%m-%d') BETWEEN '02-28' AND '04-10' AND year({{0}}) BETWEEN 1995 AND 2001 AS INTEGER) AS Is_Ramadan,
 CAST({{0}} >= DATE '1999-05-01' AS INTEGER) AS Is_Post_Rebranding,
 round(greatest(date_diff('day', DATE '1999-05-01', {{0}}) / 7.0::DOUBLE, 0.0), 6) AS Weeks_Since_Rebrand"""
ORACLES["calendar_features"] = f"""SELECT "Date", {CALENDAR_SQL.format('"Date"', 'origin')} FROM {_DAYS}"""


def calendar_features_ext(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("Date")).distinct()
    found = add_calendar(days, STAR_CALENDAR, extended=True)
    return found.select(
        "Date", "Quarter", "Is_Weekend", numeric.rounded("Sin_Month", 6).alias("Sin_Month"),
        numeric.rounded("Cos_Month", 6).alias("Cos_Month"), "Days_Since_Start", "Day_Of_Month", "Is_Payday",
        "Is_Near_Holiday", "Days_Since_Rebrand", "Payday_Weekend", "Holiday_Weekend")




def _near(month: int, day: int) -> str:
    """Within three days of that date in the year before, of, or after (for use inside a format text)."""
    return f"""list_bool_or([abs(date_diff('day', make_date(year({{0}}) + y, {month}, {day}), {{0}})) <= 3
   AND year({{0}}) + y BETWEEN 1995 AND 2001 for y in [-1, 0, 1]])"""


EXTENDED_SQL = f"""quarter({{0}}) AS Quarter, CAST(isodow({{0}}) >= 6 AS INTEGER) AS Is_Weekend,
 round(sin(2 * pi() * month({{0}}) / 12), 6) + 0.0 AS Sin_Month, round(cos(2 * pi() * month({{0}}) / 12), 6) + 0.0 AS Cos_Month,
 date_diff('day', {{1}}, {{0}}) AS Days_Since_Start, day({{0}}) AS Day_Of_Month,
 CAST(day({{0}}) <= 7 OR day({{0}}) >= 25 AS INTEGER) AS Is_Payday,
 CAST({_near(1, 1)} OR {_near(5, 1)} OR {_near(12, 25)} AS INTEGER) AS Is_Near_Holiday,
 greatest(date_diff('day', DATE '1999-05-01', {{0}}), 0) AS Days_Since_Rebrand,
 CAST((day({{0}}) <= 7 OR day({{0}}) >= 25) AND isodow({{0}}) >= 6 AS INTEGER) AS Payday_Weekend,
 CAST({_HOLIDAY} AND isodow({{0}}) >= 6 AS INTEGER) AS Holiday_Weekend"""
ORACLES["calendar_features_ext"] = f"""SELECT "Date", {EXTENDED_SQL.format('"Date"', 'origin')} FROM {_DAYS}"""


def sales_cleaned_project(spark, sf):
    lines = sale_lines(spark, sf, party=True).withColumn(
        "Variant", F.when(F.col("Line") == 3, F.lit("  ")).when(F.col("Line") == 4, F.lit("nan")).otherwise(F.col("Variant")))
    found = cleaning.snake_case_sales(lines)
    return found.withColumns({c: numeric.rounded(c, 4) for c in ("discounts", "net_sales")}).withColumn(
        "taxes", numeric.rounded("taxes", 6))


ORACLES["sales_cleaned_project"] = with_("sales", body="""
SELECT CAST("Date" AS TIMESTAMP) AS date, CAST(receipt AS VARCHAR) AS receipt_number, receipt_type, raw_category AS category, Item AS item,
 CASE WHEN line IN (3, 4) THEN NULL ELSE variant END AS variant, modifier AS modifiers_applied, q AS quantity, gross AS gross_sales,
 round(discounts, 4) AS discounts, round(net, 4) AS net_sales, round(taxes, 6) AS taxes, dining AS dining_option, s_name AS store, c_name AS customer_name, status
FROM sales JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey""")


def dim_items_upsert(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    existing = views.item_dim(spark, sf).where(~F.col("name").startswith("new ")).select("id", "name")
    return existing.unionByName(dimensions.new_names(existing, names))


_ITEM_DIM = """dimcats AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_type AS name FROM part WHERE p_type <> 'PROMO')),
dimitems AS (SELECT row_number() OVER (ORDER BY Item) AS id, Item AS name, d.id AS category_id
 FROM cats LEFT JOIN dimcats d ON d.name = Category WHERE Item NOT LIKE 'old %')"""
ORACLES["dim_items_upsert"] = f"""WITH cats AS ({VIEWS['cats']}), {_ITEM_DIM},
have AS (SELECT id, name FROM dimitems WHERE name NOT LIKE 'new %')
SELECT id, name FROM have UNION ALL
SELECT (SELECT max(id) FROM have) + row_number() OVER (ORDER BY p_name), p_name
FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT name FROM have))"""


def fact_insert_if_absent(spark, sf):
    """Facts before 1998 are already stored (with other quantities); the rest are inserted."""
    facts = dimensions.item_facts(views.demand(spark, sf), views.item_dim(spark, sf))
    stored = facts.where(F.col("date") < F.lit("1998-01-01").cast("date")).withColumn(
        "quantity_sold", F.col("quantity_sold") * 2)
    return stored.unionByName(dimensions.absent_rows(stored, facts, ["date", "item_id"]))


ORACLES["fact_insert_if_absent"] = f"""WITH cats AS ({VIEWS['cats']}), sales AS ({VIEWS['sales']}), {_ITEM_DIM}
SELECT "Date" AS date, d.id AS item_id, sum(q) * CASE WHEN "Date" < DATE '1998-01-01' THEN 2 ELSE 1 END AS quantity_sold
FROM sales JOIN dimitems d ON d.name = Item GROUP BY "Date", d.id"""


def category_facts_absent(spark, sf):
    """The rows to append at the category grain; days before 1998 are stored already."""
    daily = aggregates.daily_category_sales(views.daily_items(spark, sf))
    facts = dimensions.category_facts(daily, views.category_dim(spark, sf))
    found = dimensions.absent_rows(facts.where(F.col("date") < F.lit("1998-01-01").cast("date")), facts, ["date", "category_id"])
    return found.withColumns({c: numeric.rounded(c, 4) for c in ("net_sales", "gross_sales")})


ORACLES["category_facts_absent"] = f"""WITH cats AS ({VIEWS['cats']}), sales AS ({VIEWS['sales']}), {_ITEM_DIM}
SELECT "Date" AS date, d.id AS category_id, sum(q) AS quantity, round(sum(net), 4) AS net_sales, round(sum(gross), 4) AS gross_sales,
 count(DISTINCT s.Item) AS unique_items
FROM sales s JOIN cats c ON c.Item = s.Item JOIN dimcats d ON d.name = c.Category
WHERE q > 0 AND "Date" >= DATE '1998-01-01' GROUP BY "Date", d.id"""


def total_facts_absent(spark, sf):
    """The rows to append at the total grain."""
    facts = dimensions.total_facts(aggregates.daily_total_sales(views.daily_items(spark, sf)))
    found = dimensions.absent_rows(facts.where(F.col("date") < F.lit("1998-01-01").cast("date")), facts, ["date"])
    return found.withColumns({c: numeric.rounded(c, 4) for c in ("net_sales", "gross_sales")})


ORACLES["total_facts_absent"] = with_("sales", body="""
SELECT "Date" AS date, sum(q) AS quantity, round(sum(net), 4) AS net_sales, round(sum(gross), 4) AS gross_sales, count(DISTINCT Item) AS unique_items
FROM sales WHERE q > 0 AND "Date" >= DATE '1998-01-01' GROUP BY "Date" """)


def condiment_load(spark, sf):
    """Condiment lines as the recipe load stores them; some amounts are no numbers."""
    bom = adapters.condiment_bom(spark, sf)
    worded = bom.withColumn("Qty_per_condiment_unit", F.when(F.length("Sub_Ingredient") % 5 == 0, F.lit("some")).otherwise(
        F.col("Qty_per_condiment_unit").cast("string")))
    return dimensions.resolve_condiments(worded)


ORACLES["condiment_load"] = f"""WITH cond AS ({VIEWS['cond']})
SELECT parent AS condiment, CAST(batch AS DOUBLE) AS condiment_qty, 'gr' AS condiment_unit, child AS sub_ingredient,
 CAST(q AS DOUBLE) AS qty_per_unit, 'gr' AS sub_unit FROM cond WHERE length(child) % 5 <> 0"""


def bom_resolve_ids(spark, sf):
    bom = adapters.menu_bom(spark, sf).withColumn(
        "Qty", F.when(F.col("Qty") > 0.5, F.lit("half a kilo")).otherwise(F.col("Qty").cast("string")))
    return dimensions.resolve_bom(bom, views.category_dim(spark, sf), views.item_dim(spark, sf).select("id", "name"))


ORACLES["bom_resolve_ids"] = f"""WITH cats AS ({VIEWS['cats']}), bom AS ({VIEWS['bom']}), {_ITEM_DIM}
SELECT Tipe AS category_name, Item AS item_name, Bahan AS ingredient, Qty AS quantity, 'gr' AS unit, c.id AS category_id, d.id AS item_id
FROM bom LEFT JOIN dimcats c ON c.name = Tipe LEFT JOIN dimitems d ON d.name = Item WHERE Qty <= 0.5"""


def items_with_category(spark, sf):
    return serving.items_with_category(views.item_dim(spark, sf), views.category_dim(spark, sf))


ORACLES["items_with_category"] = f"""WITH cats AS ({VIEWS['cats']}), {_ITEM_DIM}
SELECT i.name AS item, c.name AS category FROM dimitems i LEFT JOIN dimcats c ON c.id = i.category_id"""

ITEM_DIM_SQL = _ITEM_DIM
QUERIES |= {name: globals()[name] for name in ORACLES}

"""Queries over recipes, material needs and basket rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from demandloom.functions import text
from demandloom.functions.numeric import rounded
from demandloom.operators import bom, rules, serving
from demandloom.operators.registry import items_of_run
from demandloom.plans import views
from demandloom.plans.oracle_views import VIEWS, initcap, with_
from demandloom.sources import adapters

QUERIES, ORACLES = {}, {}
_BOM = ("cond", "walk", "leaves", "bom", "item_leaf")
RECIPE_VIEWS = ("products", "variants", "materials", "condiments", "units", "recipe_lines", "condiment_lines", "links", "categories")


def material_name_sql(column: str) -> str:
    return f"CASE WHEN upper(trim({column})) IN ('SKM', 'BSJ', 'SP') THEN upper(trim({column})) ELSE {initcap(f'trim({column})')} END"


def bom_menu_flatten(spark, sf):
    return bom.flatten_menu(adapters.recipe_tables(spark, sf))


# What a line can name: 'm' or 'c' and an id, with the name and the code of its unit.
_PIECES = """pieces AS (
 SELECT 'm' || id AS ref, name, list_extract(map_extract((SELECT map_from_entries(list((id, code))) FROM units), unit_id), 1) AS code FROM materials
 UNION ALL
 SELECT 'c' || id, name, list_extract(map_extract((SELECT map_from_entries(list((id, code))) FROM units), unit_id), 1) FROM condiments)"""
ORACLES["bom_menu_flatten"] = with_(*RECIPE_VIEWS, body=f"""
, {_PIECES},
off AS (SELECT 'v' || id AS ref FROM variants WHERE is_active IS NOT TRUE UNION ALL SELECT 'm' || id FROM materials WHERE is_active IS NOT TRUE),
live AS (
 SELECT * FROM recipe_lines WHERE product_id IN (SELECT id FROM products WHERE is_active)
 AND NOT EXISTS (FROM off WHERE off.ref = 'v' || variant_id) AND NOT EXISTS (FROM off WHERE off.ref = 'm' || material_id)),
labels AS (SELECT product_id, categories.name AS label FROM links LEFT JOIN categories ON categories.id = category_id),
titled AS (
 SELECT live.*, (SELECT max(name) FROM products WHERE id = product_id) || coalesce(nullif(' ' || (SELECT max(name) FROM variants WHERE id = variant_id), ' default'), '') AS title FROM live)
SELECT coalesce(label, 'Uncategorized') AS Tipe, title AS Item, coalesce(one.name, other.name) AS Bahan, quantity AS Qty, coalesce(one.code, other.code, '') AS Unit
FROM titled LEFT JOIN labels USING (product_id) LEFT JOIN pieces one ON one.ref = 'm' || material_id LEFT JOIN pieces other ON other.ref = 'c' || condiment_id""")


def bom_condiment_flatten(spark, sf):
    return bom.flatten_condiments(adapters.recipe_tables(spark, sf))


ORACLES["bom_condiment_flatten"] = with_("materials", "condiments", "units", "condiment_lines", body=f"""
, {_PIECES},
inner_parts AS (SELECT condiment_id, quantity, coalesce('m' || material_id, 'c' || child_condiment_id) AS ref FROM condiment_lines)
SELECT owner.name AS Condiment, batch_quantity AS Condiment_Qty, owner.code AS Condiment_Unit, part.name AS Sub_Ingredient, quantity AS Qty_per_condiment_unit,
 CASE WHEN inner_parts.ref LIKE 'm%' THEN part.code END AS Sub_Unit
FROM inner_parts JOIN condiments ON condiments.id = condiment_id JOIN pieces owner ON owner.ref = 'c' || condiment_id LEFT JOIN pieces part ON part.ref = inner_parts.ref""")


def bom_explode_level1(spark, sf):
    found = bom.explode_level_one(adapters.demand_lines(spark, sf), adapters.menu_bom(spark, sf))
    return found.withColumn("Qty", rounded("Qty", 4))


ORACLES["bom_explode_level1"] = with_("sales", "bom", body="""
SELECT "Date", Bahan, round(sum(d.q * b.Qty), 4) AS Qty FROM (SELECT "Date", Item, sum(q) AS q FROM sales WHERE q > 0 GROUP BY 1, 2) d JOIN bom b USING (Item) GROUP BY 1, 2""")


def bom_explode_recursive(spark, sf):
    found = bom.item_materials(adapters.menu_bom(spark, sf), adapters.condiment_bom(spark, sf))
    return found.select("key", "Material", rounded("per_unit", 6).alias("per_unit"))


ORACLES["bom_explode_recursive"] = with_(*_BOM, recursive=True, body="SELECT Item AS key, leaf AS Material, round(f, 6) AS per_unit FROM item_leaf")


def material_requirements(spark, sf):
    found = bom.material_requirements(
        adapters.demand_lines(spark, sf), adapters.menu_bom(spark, sf), adapters.condiment_bom(spark, sf))
    return found.withColumn("Quantity_Required", rounded("Quantity_Required", 4))


VIEWS["needs"] = f"""
 SELECT "Date", {material_name_sql('leaf')} AS Raw_Material, sum(d.q * l.f) AS Quantity_Required
 FROM (SELECT "Date", Item, sum(q) AS q FROM sales WHERE q > 0 GROUP BY 1, 2) d JOIN item_leaf l USING (Item) GROUP BY 1, 2"""
ORACLES["material_requirements"] = with_("sales", *_BOM, "needs", recursive=True, body="""
SELECT "Date", Raw_Material, round(Quantity_Required, 4) AS Quantity_Required FROM needs""")


def top_materials(spark, sf):
    found = bom.top_materials(bom.material_requirements(
        adapters.demand_lines(spark, sf), adapters.menu_bom(spark, sf), adapters.condiment_bom(spark, sf)))
    return found.withColumn("Quantity_Required", rounded("Quantity_Required", 3))


ORACLES["top_materials"] = with_("sales", *_BOM, "needs", recursive=True, body="""
SELECT Raw_Material, round(sum(Quantity_Required), 3) AS Quantity_Required FROM needs GROUP BY 1 ORDER BY sum(Quantity_Required) DESC, 1 LIMIT 20""")


def _stored_materials(spark, sf):
    found = bom.material_requirements(
        adapters.demand_lines(spark, sf), adapters.menu_bom(spark, sf), adapters.condiment_bom(spark, sf))
    return found.toDF("date", "raw_material", "quantity_required")


def materials_filter(spark, sf):
    found = serving.materials(_stored_materials(spark, sf), "BRAND#2", "1996-01-01", "1998-06-30")
    return found.withColumn("quantity_required", rounded("quantity_required", 4))


ORACLES["materials_filter"] = with_("sales", *_BOM, "needs", recursive=True, body="""
SELECT "Date" AS date, Raw_Material AS raw_material, round(Quantity_Required, 4) AS quantity_required FROM needs
WHERE Raw_Material ILIKE '%brand#2%' AND "Date" BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'""")


def recipe_materials(spark, sf):
    """Daily sales of items by product name, half of them with a variant in the name."""
    t = adapters.recipe_tables(spark, sf)
    lines = adapters.sale_lines(spark, sf)
    sold = lines.select(
        "Date", F.when(F.col("Line") % 2 == 0, F.concat_ws(" ", F.upper("Item"), "Category")).otherwise(F.col("Item")).alias("Item"),
        "Quantity")
    found = bom.recipe_requirements(sold, t)
    return found.withColumn("Quantity_Required", rounded("Quantity_Required", 3))


# Leaf materials in one unit of each item key, by the two-tier match.
RECIPE_SQL = """
, lines AS (SELECT lower(p.name) AS product_key, lower(CASE WHEN v.name IS NOT NULL THEN p.name || ' ' || v.name ELSE p.name END) AS item_key, m.name AS material, c.name AS condiment, r.quantity AS qty
  FROM recipe_lines r JOIN products p ON p.id = r.product_id LEFT JOIN variants v ON v.id = r.variant_id LEFT JOIN materials m ON m.id = r.material_id LEFT JOIN condiments c ON c.id = r.condiment_id WHERE p.is_active),
recipes AS (SELECT item_key AS key, material, condiment, qty FROM lines UNION ALL
  SELECT product_key, material, condiment, qty FROM lines WHERE product_key NOT IN (SELECT item_key FROM lines)),
subs AS (SELECT c.name AS condiment, m.name AS sub, ci.quantity / CASE WHEN coalesce(c.batch_quantity, 0) = 0 THEN 1.0 ELSE c.batch_quantity END AS rate
  FROM condiment_lines ci JOIN condiments c ON c.id = ci.condiment_id LEFT JOIN materials m ON m.id = ci.material_id),
parts AS (SELECT key, material AS raw, qty FROM recipes WHERE material IS NOT NULL UNION ALL
  SELECT key, sub, qty * rate FROM recipes JOIN subs USING (condiment) WHERE sub IS NOT NULL UNION ALL
  SELECT key, condiment, qty FROM recipes WHERE condiment IS NOT NULL AND condiment NOT IN (SELECT condiment FROM subs)),
unit AS (SELECT key, raw, sum(qty) AS qty FROM parts GROUP BY 1, 2)"""
ORACLES["recipe_materials"] = with_("sales", *RECIPE_VIEWS, body=RECIPE_SQL + """,
sold AS (SELECT "Date", lower(CASE WHEN line % 2 = 0 THEN upper(Item) || ' ' || raw_category ELSE Item END) AS key, sum(q) AS q FROM sales GROUP BY 1, 2)
SELECT "Date", raw AS Raw_Material, round(sum(q * qty), 3) AS Quantity_Required FROM sold JOIN unit USING (key) GROUP BY 1, 2""")


# --- basket rules ----------------------------------------------------------------------------

_SUPPORT, _PAIR_SUPPORT = 0.01, 0.001


def association_rules(spark, sf):
    """Rules over categories, antecedents of any length."""
    found = rules.as_rule_text(rules.association_rules(
        adapters.basket_lines(spark, sf), _SUPPORT, 0.3, item="Category"))
    return found.withColumns({c: rounded(c, 6) for c, kind in found.dtypes if kind == "double"})


# Every set of the six categories as bits, its baskets counted by containment.
_BITS = "CASE raw_category WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 4 WHEN 'PROMO' THEN 8 WHEN 'SMALL' THEN 16 ELSE 32 END"
_SET_TEXT = """'frozenset({' || array_to_string(list_transform(list_filter([(1, 'ECONOMY'), (2, 'LARGE'), (4, 'MEDIUM'), (8, 'PROMO'), (16, 'SMALL'), (32, 'STANDARD')],
 lambda e: ({0} & e[1]) > 0), lambda e: chr(39) || e[2] || chr(39)), ', ') || '})'"""
ORACLES["association_rules"] = with_("sales", body=f"""
, masks AS (SELECT receipt, CAST(bit_or({_BITS}) AS BIGINT) AS m FROM sales GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM masks),
sets AS (SELECT s, count(*) AS c FROM generate_series(1, 63) t(s), masks WHERE (m & s) = s GROUP BY 1 HAVING count(*) >= (SELECT ceil({_SUPPORT}::DOUBLE * n) FROM n)),
r AS (SELECT w.s - b.s AS a, b.s AS b, w.c AS ab, x.c AS ca, b.c AS cb FROM sets w JOIN sets b ON (w.s & b.s) = b.s AND bit_count(b.s) = 1 AND w.s <> b.s JOIN sets x ON x.s = w.s - b.s),
q AS (SELECT a, b, ab / n AS support, ab / ca AS confidence, ab * n / (ca::DOUBLE * cb) AS lift, ca / n AS pa, cb / n AS pb FROM r, n WHERE ab / ca >= 0.3)
SELECT {_SET_TEXT.replace('{0}', 'a')} AS antecedents, {_SET_TEXT.replace('{0}', 'b')} AS consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
 1.0::DOUBLE AS representativity, round(support - pa * pb, 6) + 0.0 AS leverage, round((1 - pb) / nullif(1 - confidence, 0), 6) AS conviction,
 round((support - pa * pb) / nullif(greatest(support * (1 - pa), pa * (pb - support)), 0), 6) + 0.0 AS zhangs_metric, round(support / (pa + pb - support), 6) AS jaccard FROM q""")


def _item_rules(spark, sf):
    return rules.association_rules(adapters.basket_lines(spark, sf), _PAIR_SUPPORT, 0.0)


def pair_rules_metrics(spark, sf):
    """All measures of the rules between items, antecedents of any length."""
    found = _item_rules(spark, sf)
    one = found.withColumns({"antecedents": F.array_join("antecedents", "|"), "consequents": F.col("consequents")[0]})
    return one.withColumns({c: rounded(c, 6) for c, kind in found.dtypes if kind == "double"})


VIEWS["basket"] = "SELECT DISTINCT receipt, Item FROM sales"
VIEWS["nb"] = "SELECT count(DISTINCT receipt)::DOUBLE AS nb FROM basket"
VIEWS["common"] = f"""
 SELECT receipt, Item FROM basket WHERE Item IN (
  SELECT Item FROM basket GROUP BY 1 HAVING count(*) >= (SELECT ceil({_PAIR_SUPPORT}::DOUBLE * nb) FROM nb))"""
# Sets grow by one later item of the same basket; only sets that stay frequent count.
VIEWS["grown"] = """
 SELECT receipt, [Item] AS s, Item AS top FROM common UNION ALL
 SELECT g.receipt, list_append(g.s, c.Item), c.Item FROM grown g JOIN common c ON c.receipt = g.receipt AND c.Item > g.top"""
VIEWS["frequent"] = f"""
 SELECT s, count(*) AS n FROM grown GROUP BY 1 HAVING count(*) >= (SELECT ceil({_PAIR_SUPPORT}::DOUBLE * nb) FROM nb)"""
VIEWS["pairs"] = """
 SELECT a, b, n_ab / nb AS support, n_ab / n_a AS confidence, n_ab * nb / (n_a * n_b) AS lift, n_a / nb AS pa, n_b / nb AS pb, n_ab / nb AS pab FROM (
  SELECT list_filter(w.s, lambda x: x <> w.one) AS a, w.one AS b, w.n AS n_ab FROM (SELECT s, n, unnest(s) AS one FROM frequent WHERE len(s) > 1) w)
 JOIN (SELECT s AS a, n AS n_a FROM frequent) USING (a) JOIN (SELECT s[1] AS b, n AS n_b FROM frequent WHERE len(s) = 1) USING (b), nb"""
_PAIRS = ("sales", "basket", "nb", "common", "grown", "frequent", "pairs")
ORACLES["pair_rules_metrics"] = with_(*_PAIRS, recursive=True, body="""
SELECT array_to_string(a, '|') AS antecedents, b AS consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, 1.0::DOUBLE AS representativity,
 round(pab - pa * pb, 6) + 0.0 AS leverage, round((1 - pb) / nullif(1 - confidence, 0), 6) AS conviction,
 round((pab - pa * pb) / nullif(greatest(pab * (1 - pa), pa * (pb - pab)), 0), 6) + 0.0 AS zhangs_metric, round(pab / (pa + pb - pab), 6) AS jaccard FROM pairs""")


def association_rules_top(spark, sf):
    found = rules.top_rules(rules.as_rule_text(_item_rules(spark, sf)), 0.05, 0.5)
    return found.select("antecedents", "consequents", *[rounded(c, 6).alias(c) for c in ("support", "confidence", "lift")])


_TEXT = "'frozenset({' || array_to_string(list_transform({0}, lambda x: chr(39) || x || chr(39)), ', ') || '})'"
_TOP = f"""SELECT {_TEXT.replace('{0}', 'a')} AS antecedents, {_TEXT.replace('{0}', '[b]')} AS consequents, support, confidence, lift, b FROM pairs
WHERE confidence >= 0.05 AND lift >= 0.5 ORDER BY lift DESC, 1, 2 LIMIT 100"""
ORACLES["association_rules_top"] = with_(*_PAIRS, recursive=True, body=f"""
SELECT antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM ({_TOP})""")


def rule_text_parse(spark, sf):
    """Set text of every rule, read back by both parsers: the last item of a set, and all items."""
    written = rules.as_rule_text(_item_rules(spark, sf))
    return written.select(
        "antecedents", "consequents",
        text.single_item_of_set_text(F.col("antecedents")).alias("antecedent"),
        F.array_join(text.items_of_rule_text(F.regexp_replace("consequents", "^frozenset", "")), "|").alias("consequent_items"))


ORACLES["rule_text_parse"] = with_(*_PAIRS, recursive=True, body=f"""
SELECT {_TEXT.replace('{0}', 'a')} AS antecedents, {_TEXT.replace('{0}', '[b]')} AS consequents, a[-1] AS antecedent, lower(b) AS consequent_items FROM pairs""")


def rules_for_model(spark, sf):
    """Top rules whose consequent is among the items of the latest active forest run."""
    tables = views.run_tables(spark, sf)
    # A run's items with models are rows of their own; the given runs' are their accurate items.
    own = tables.top_items.where(F.col("accuracy_pct") >= 95).select("model_run_id", "item_name")
    items = items_of_run(replace(tables, item_models=own), "forest")
    written = rules.as_rule_text(_item_rules(spark, sf))
    plain = written.withColumns({c: text.single_item_of_set_text(F.col(c)) for c in ("antecedents", "consequents")})
    found = rules.rules_for_items(plain, items, 0.05, 0.5)
    return found.select("antecedents", "consequents", *[rounded(c, 6).alias(c) for c in ("support", "confidence", "lift")])


ORACLES["rules_for_model"] = with_(*_PAIRS, "runs", "top_rows", recursive=True, body="""
, wanted AS (SELECT lower(item_name) AS item FROM top_rows WHERE accuracy_pct >= 95 AND model_run_id = (
   SELECT id FROM runs WHERE is_active AND model_type = 'forest' ORDER BY trained_at DESC, id DESC LIMIT 1)),
top AS (SELECT a[-1] AS a, b, support, confidence, lift FROM pairs WHERE confidence >= 0.05 AND lift >= 0.5 ORDER BY lift DESC, 1, b LIMIT 100)
SELECT a AS antecedents, b AS consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift
FROM top WHERE lower(b) IN (SELECT item FROM wanted)""")

QUERIES |= {name: globals()[name] for name in ORACLES}

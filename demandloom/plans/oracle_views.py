"""DuckDB text of the adapter views, used to build the oracle queries."""

from __future__ import annotations


def with_(*views: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named views (in the given order) in front of ``body``."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in views) + "\n" + body


def initcap(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, ' '), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


VIEWS: dict[str, str] = {}

VIEWS["sales"] = """
 SELECT CAST(o_orderdate AS DATE) AS "Date", l_orderkey AS receipt, l_linenumber AS line,
        CASE WHEN l_returnflag = 'R' THEN 'Refund' ELSE 'Sale' END AS receipt_type,
        p_type AS raw_category, p_name AS Item, p_brand AS variant,
        CASE p_size % 3 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Ice' END AS modifier,
        l_quantity AS q, l_extendedprice AS gross, l_extendedprice * l_discount AS discounts,
        l_extendedprice * (1 - l_discount) AS net,
        l_extendedprice * (1 - l_discount) * l_tax AS taxes,
        o_orderpriority AS dining, o_orderstatus AS status, l_suppkey, o_custkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

VIEWS["cats"] = "SELECT p_name AS Item, arg_min(p_type, p_partkey) AS Category FROM part GROUP BY 1"

VIEWS["daily"] = """
 SELECT s."Date", s.Item, coalesce(c.Category, 'Unknown') AS Category, sum(q) AS q, sum(net) AS net, sum(gross) AS gross
 FROM sales s LEFT JOIN cats c USING (Item) WHERE q > 0 GROUP BY 1, 2, 3"""

VIEWS["weekly_sums"] = """
 SELECT Item, "Date" + CAST((8 - isodow("Date")) % 7 AS INTEGER) AS "Date", sum(q) AS q
 FROM sales WHERE NOT starts_with(lower(trim(Item)), 'add') GROUP BY 1, 2"""

VIEWS["weekly"] = """
 SELECT g.Item, g."Date", coalesce(w.q, 0.0) AS q FROM (
   SELECT Item, CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 7 DAY)) AS DATE) AS "Date"
   FROM weekly_sums GROUP BY Item) g
 LEFT JOIN weekly_sums w ON w.Item = g.Item AND w."Date" = g."Date" """

VIEWS["dailyseries"] = """
 SELECT g.Item, g."Date", coalesce(w.q, 0.0) AS q FROM (
   SELECT Item, CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date"
   FROM sales GROUP BY Item) g
 LEFT JOIN (SELECT Item, "Date", sum(q) AS q FROM sales GROUP BY 1, 2) w ON w.Item = g.Item AND w."Date" = g."Date" """

VIEWS["totals"] = 'SELECT "Date", sum(q) AS q FROM sales GROUP BY 1'
VIEWS["numbered"] = 'SELECT "Date", q, row_number() OVER (ORDER BY "Date") AS i FROM totals'

VIEWS["vol"] = "SELECT Item, sum(q) AS vol FROM sales GROUP BY 1"
VIEWS["abc"] = """
 SELECT Item, vol, cum, cum / total AS pct,
        CASE WHEN cum / total <= 0.70 THEN 'A' WHEN cum / total <= 0.90 THEN 'B' ELSE 'C' END AS cls, total
 FROM (SELECT Item, vol, sum(vol) OVER (ORDER BY vol DESC, Item ROWS UNBOUNDED PRECEDING) AS cum,
              sum(vol) OVER () AS total FROM vol)"""

# Hold-out rows with a four-week mean as the forecast.
VIEWS["heldout"] = """
 SELECT * FROM (
   SELECT Item, "Date", q, round_even(avg(q) OVER (PARTITION BY Item ORDER BY "Date" ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS p,
          max("Date") OVER () AS last FROM weekly)
 WHERE "Date" >= last - 84 AND p IS NOT NULL"""

VIEWS["bom"] = "SELECT p_name AS Item, p_brand AS Bahan, sum(p_size) / 100.0 AS Qty, min(p_type) AS Tipe FROM part GROUP BY 1, 2"
VIEWS["cond"] = """
 SELECT p_brand AS parent, p_type AS child, sum(p_size) AS q, sum(sum(p_size)) OVER (PARTITION BY p_brand) AS batch
 FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) <= 15 GROUP BY 1, 2
 UNION ALL
 SELECT c, r_name, r_regionkey + 1, 10 FROM region, (VALUES ('ECONOMY'), ('PROMO'), ('SMALL')) t(c)"""
VIEWS["walk"] = """
 SELECT DISTINCT parent AS root, parent AS node, CAST(1.0 AS DOUBLE) AS f FROM cond
 UNION ALL
 SELECT w.root, c.child, w.f * c.q / c.batch FROM walk w JOIN cond c ON c.parent = w.node"""
VIEWS["leaves"] = """
 SELECT root, node AS leaf, sum(f) AS f FROM walk
 WHERE node NOT IN (SELECT parent FROM cond) GROUP BY 1, 2"""
VIEWS["item_leaf"] = """
 SELECT b.Item, coalesce(l.leaf, b.Bahan) AS leaf, sum(b.Qty * coalesce(l.f, 1.0)) AS f
 FROM bom b LEFT JOIN leaves l ON l.root = b.Bahan GROUP BY 1, 2"""

VIEWS["menu"] = f"""
 SELECT CASE WHEN p_name LIKE 'new %' THEN {initcap('p_name')} || CASE WHEN p_size % 3 = 0 THEN ' Hot' ELSE ' Ice' END
             WHEN p_name LIKE 'small %' THEN {initcap('p_name')} || ' Hot'
             WHEN p_name LIKE 'large %' THEN {initcap('p_name')} || ' Ice'
             ELSE {initcap('p_name')} END AS Item, arg_min(p_type, p_partkey) AS Tipe
 FROM part WHERE p_name NOT LIKE 'old %' GROUP BY 1"""

VIEWS["products"] = "SELECT p_partkey AS id, p_name AS name, p_size > 5 AS is_active FROM part"
VIEWS["variants"] = """
 SELECT p_partkey AS id, p_partkey AS product_id, CASE WHEN p_size % 4 = 0 THEN 'default' ELSE p_type END AS name,
        p_size % 10 <> 0 AS is_active FROM part WHERE p_size % 2 = 0"""
VIEWS["materials"] = """
 SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS unit_id,
        s_acctbal > 1000 AS is_active FROM supplier"""
VIEWS["condiments"] = """
 SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS batch_quantity,
        n_regionkey AS unit_id FROM nation"""
VIEWS["units"] = "SELECT r_regionkey AS id, r_name AS code FROM region"
VIEWS["recipe_lines"] = """
 SELECT l_partkey AS product_id, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey END AS variant_id,
        CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END AS material_id,
        CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey % 25 END AS condiment_id,
        round(sum(l_tax) * 100, 0) + 1 AS quantity
 FROM lineitem GROUP BY l_partkey, l_suppkey"""
VIEWS["condiment_lines"] = """
 SELECT s_nationkey AS condiment_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS material_id,
        CASE WHEN s_suppkey % 5 = 0 THEN (s_nationkey + 1) % 25 END AS child_condiment_id,
        CAST(s_suppkey % 7 + 1 AS DOUBLE) AS quantity FROM supplier"""
VIEWS["links"] = """
 SELECT p_partkey AS product_id, CASE WHEN p_size % 5 <> 0 THEN CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) END AS category_id FROM part"""
VIEWS["categories"] = "SELECT n_nationkey AS id, n_name AS name FROM nation"

_RUN = "(year(o_orderdate) - 1995) * 5 + CAST(left(o_orderpriority, 1) AS INTEGER)"
VIEWS["runs"] = f"""
 SELECT id, CASE d WHEN '1' THEN 'boosted' WHEN '2' THEN 'forest' WHEN '3' THEN 'arima' WHEN '4' THEN 'additive' ELSE 'boosted' END AS model_type,
        trained_at, n_records, CAST(trained_at AS DATE) AS date_range_end,
        CASE WHEN y % 2 = 0 THEN m END AS r2, m * 100 AS wmape, m AS mae,
        CASE WHEN d = '2' THEN 0.0 ELSE m * 90 END AS median_period_accuracy, m * 80 AS volume_accuracy,
        m * 50 AS periods_within_20pct, CASE WHEN y <> 2001 THEN m * 70 END AS periods_within_50pct, y >= 2000 AS is_active
 FROM (SELECT {_RUN} AS id, left(o_orderpriority, 1) AS d, year(o_orderdate) AS y, max(o_orderdate) AS trained_at,
              count(*) AS n_records, round(avg(o_totalprice) / 1e6, 4) AS m FROM orders GROUP BY 1, 2, 3)"""
VIEWS["forecasts"] = f"""
 SELECT {_RUN} AS model_run_id, p_name AS item_name, CAST(o_orderdate AS DATE) AS "date", sum(l_quantity) AS quantity_predicted
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""
VIEWS["class_metrics"] = f"""
 SELECT {_RUN} AS model_run_id, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS abc_class,
        count(DISTINCT p_name) AS n_items, round(avg(l_discount) * 100, 4) AS wmape, round(avg(l_tax) * 1000, 4) AS volume_accuracy,
        CASE WHEN max(l_orderkey) % 2 = 0 THEN round(avg(l_tax) * 1200, 4) END AS median_period_accuracy
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
VIEWS["top_rows"] = f"""
 SELECT model_run_id, item_name, quantity_sold, predicted,
        round(100.0 * (1 - abs(predicted - quantity_sold) / quantity_sold), 4) AS accuracy_pct
 FROM (SELECT {_RUN} AS model_run_id, p_name AS item_name, sum(l_quantity) AS quantity_sold,
              sum(round(l_quantity * (1 - l_discount), 0)) AS predicted
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

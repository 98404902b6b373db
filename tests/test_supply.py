"""Recipes, nested condiments, recipe schema and basket rules."""

import itertools
import random

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.operators import bom, rules
from helpers import D, rows

MENU = "Tipe string, Item string, Bahan string, Qty string, Unit string"
COND = ("Condiment string, Condiment_Qty string, Condiment_Unit string, Sub_Ingredient string, "
        "Qty_per_condiment_unit string, Sub_Unit string")
SALES = "Date date, Item string, Quantity double"


def condiments(spark, *data):
    return spark.createDataFrame([(c, q, "gr", s, a, "gr") for c, q, s, a in data], COND)


def menu(spark, *data):
    return spark.createDataFrame([("T", i, b, q, "gr") for i, b, q in data], MENU)


def test_creamer_worked_value(spark):
    c = condiments(spark, ("BSJ - Creamer", "1000", "Creamer Bubuk", "1000"), ("BSJ - Creamer", "1000", "Cleo Galon", "2000"))
    got = {r["Material"]: r["Unit_Qty"] * 100 for r in bom.unit_expansion(c).collect()}
    assert got == {"Creamer Bubuk": pytest.approx(100.0), "Cleo Galon": pytest.approx(200.0)}


def test_nested_and_skipped_lines(spark):
    c = condiments(spark, ("mix", "10", "syrup", "5"), ("mix", "10", "water", "about 3"), ("mix", "10", "ice", "2"),
                   ("syrup", "4", "sugar", "2"), ("syrup", "4", "ice", "4"), ("empty", "1", "air", "?"))
    got = {(r["Condiment"], r["Material"]): r["Unit_Qty"] for r in bom.unit_expansion(c).collect()}
    assert got == {
        ("mix", "sugar"): pytest.approx(0.25), ("mix", "ice"): pytest.approx(0.7),
        ("syrup", "sugar"): 0.5, ("syrup", "ice"): 1.0}
    sales = spark.createDataFrame(
        [(D(2025, 1, 1), " DRINK ", 2.0), (D(2025, 1, 1), "drink", 1.0), (D(2025, 1, 1), "drink", -5.0),
         (D(2025, 1, 1), "unknown", 9.0), (D(2025, 1, 1), "hollow", 4.0), (D(2025, 1, 1), "drink", None)], SALES)
    m = menu(spark, ("Drink", "mix", "10"), ("Drink", "cup", "1"), ("Drink", "lid", "one"), ("Hollow", "empty", "3"))
    needs = rows(bom.material_requirements(sales, m, c), "Raw_Material")
    assert needs == [(D(2025, 1, 1), "Cup", 3.0), (D(2025, 1, 1), "Ice", pytest.approx(21.0)), (D(2025, 1, 1), "Sugar", pytest.approx(7.5))]
    assert {r["Item"] for r in bom.items_without_recipe(sales, m).collect()} == {"unknown"}


def test_condiment_match_is_case_sensitive(spark):
    c = condiments(spark, ("Syrup", "1", "sugar", "1"))
    got = rows(bom.item_materials(menu(spark, ("a", "syrup", "2"), ("b", "Syrup", "2")), c), "key")
    assert got == [("a", "syrup", 2.0), ("b", "sugar", 2.0)]


def test_cycle_is_reported(spark):
    loop = condiments(spark, ("a", "1", "b", "1"), ("b", "1", "c", "1"), ("c", "1", "a", "1"))
    with pytest.raises(bom.BomCycleError):
        bom.unit_expansion(loop)
    with pytest.raises(bom.BomCycleError):
        bom.unit_expansion(condiments(spark, *[(f"n{i}", "1", f"n{i + 1}", "1") for i in range(6)]), max_depth=3)


def test_colliding_spellings_use_the_last_listed(spark):
    m = menu(spark, ("Latte", "milk", "1"), ("latte", "water", "5")).withColumn("n", F.monotonically_increasing_id())
    c = condiments(spark, ("x", "1", "y", "1"))
    assert rows(bom.item_materials(m, c, "n")) == [("latte", "water", 5.0)]


def test_requirements_are_linear(spark):
    sales = spark.createDataFrame([(D(2025, 1, 1 + i % 3), f"i{i % 4}", float(i + 1)) for i in range(40)], SALES)
    m = menu(spark, *[(f"I{k}", b, str(k + 1)) for k in range(4) for b in ("mix", f"raw{k}")])
    c = condiments(spark, ("mix", "2", "u", "1"), ("mix", "2", "v", "3"))
    one = rows(bom.material_requirements(sales, m, c), "Date", "Raw_Material")
    twice = rows(bom.material_requirements(sales.withColumn("Quantity", F.col("Quantity") * 2), m, c), "Date", "Raw_Material")
    assert [(d, n, pytest.approx(q * 2)) for d, n, q in one] == twice


def test_a_hot_item_is_spread_over_its_days(spark):
    """An item with a third of the demand: its rows reach the recipe in many parts, and the sums are right."""
    demand = [(D(2025, 1, 1) + dt.timedelta(days=i), "hot", 1.0) for i in range(200)] + [(D(2025, 1, 1), f"i{k}", 2.0) for k in range(400)]
    demand = spark.createDataFrame(demand, "Date date, key string, sold double")
    needs = spark.createDataFrame([("hot", "m", 3.0)] + [(f"i{k}", "n", 1.0) for k in range(400)], "key string, Raw string, per_unit double")
    found = bom._needs_by_day(demand, needs, "Raw", "Amount")
    assert rows(found.where("Raw = 'm'").agg(F.count("Date"), F.sum("Amount"))) == [(200, 600.0)]
    assert rows(found.where("Raw = 'n'")) == [(D(2025, 1, 1), "n", 800.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower() and "part#" in plan


def test_blocks_of_the_product_are_final(spark, monkeypatch):
    """Any cut into blocks gives the sums of all pairs, and no partial sums are shuffled behind the product."""
    made = random.Random(3)
    demand = [(D(2025, 1, 1) + dt.timedelta(days=made.randrange(40)), f"i{made.randrange(90)}", float(made.randrange(5))) for _ in range(900)]
    needs = [(f"i{made.randrange(100)}", f"m{made.randrange(50)}", float(made.randrange(4))) for _ in range(700)]
    want = {}
    for day, key, sold in demand:
        for other, material, per_unit in needs:
            if key == other:
                want[day, material] = want.get((day, material), 0.0) + sold * per_unit
    # Rows without a date, an item or a material link nothing.
    demand += [(None, "i1", 1.0), (D(2025, 1, 1), None, 1.0)]
    needs += [("i1", None, 1.0), (None, "m1", 1.0)]
    one = spark.createDataFrame(demand, "Date date, key string, sold double")
    two = spark.createDataFrame(needs, "key string, Raw string, per_unit double")
    for cells, materials, items, step in ((1 << 22, 1 << 15, 64, 1 << 17), (30, 4, 3, 7)):
        monkeypatch.setattr(bom, "BLOCK_CELLS", cells)
        monkeypatch.setattr(bom, "BLOCK_MATERIALS", materials)
        sums = bom._needs_by_day(one, two, "Raw", "Amount")
        assert {(d, m): a for d, m, a in rows(sums)} == want and sums.count() == len(want)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1
    block = one.where("Date IS NOT NULL AND key IS NOT NULL").selectExpr("0 block", "0 part", "key", "Date", "cast(null as string) material", "sold value").union(
        two.dropna().selectExpr("0", "0", "key", "cast(null as date)", "Raw", "per_unit")).orderBy("key").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(bom, "ITEMS", 3)
    monkeypatch.setattr(bom, "ITEM_ROWS", 7)
    got = [x for part in bom._block_sums(block.slice(i, 5) for i in range(0, block.num_rows, 5)) for x in zip(*part.to_pydict().values())]
    assert {(d, m): a for d, m, a in got} == want and len(got) == len(want)


def test_an_item_and_a_condiment_of_one_name(spark):
    t = recipe_schema(spark)
    make = spark.createDataFrame
    t["products"] = make([(1, "syrup", True), (2, "tea", True)], "id long, name string, is_active boolean")
    t["condiments"] = make([(1, "syrup", 2.0, None)], "id long, name string, batch_quantity double, unit_id long")
    t["materials"] = make([(1, "sugar", None, True)], "id long, name string, unit_id long, is_active boolean")
    t["recipe_lines"] = make([(1, None, 1, None, "5"), (2, None, None, 1, "4")],
                             "product_id long, variant_id long, material_id long, condiment_id long, quantity string")
    t["condiment_lines"] = make([(1, 1, None, 3.0)], "condiment_id long, material_id long, child_condiment_id long, quantity double")
    sold = spark.createDataFrame([(D(2025, 1, 1), "tea", 1.0), (D(2025, 1, 2), "syrup", 1.0)], SALES)
    assert rows(bom.recipe_requirements(sold, t), "Date") == [(D(2025, 1, 1), "sugar", 6.0), (D(2025, 1, 2), "sugar", 5.0)]


def test_a_batch_of_nothing_is_left_out_and_reported(spark):
    c = condiments(spark, ("empty", "0", "u", "1"), ("mix", "2", "v", "3"), ("words", "some", "w", "1"))
    assert rows(bom.unit_expansion(c), "Condiment") == [("mix", "v", 1.5)]
    assert rows(bom.batches_of_nothing(c), "Condiment") == [("empty",), ("words",)]


def recipe_schema(spark):
    make = spark.createDataFrame
    return {
        "products": make([(1, "Tea", True), (2, "Tea", True), (3, "Old", False)], "id long, name string, is_active boolean"),
        "variants": make([(1, 1, "Hot", True)], "id long, product_id long, name string, is_active boolean"),
        "materials": make([(1, "leaf", 1, True), (2, "water", None, True)], "id long, name string, unit_id long, is_active boolean"),
        "condiments": make([(1, "syrup", 0.0, 1), (2, "bare", 5.0, 1)], "id long, name string, batch_quantity double, unit_id long"),
        "units": make([(1, "gr")], "id long, code string"),
        "recipe_lines": make([(1, 1, 1, None, "2"), (2, None, 2, None, "3"), (2, None, None, 1, "1"), (2, None, None, 2, "4"), (3, None, 1, None, "1")],
                             "product_id long, variant_id long, material_id long, condiment_id long, quantity string"),
        "condiment_lines": make([(1, 1, None, 6.0), (1, None, 2, 1.0)], "condiment_id long, material_id long, child_condiment_id long, quantity double"),
        "category_links": make([(1, 1)], "product_id long, category_id long"),
        "categories": make([(1, "Drinks")], "id long, name string"),
    }


def test_recipe_two_tier_match(spark):
    t = recipe_schema(spark)
    sold = spark.createDataFrame([(D(2025, 1, 1), "TEA hot", 2.0), (D(2025, 1, 2), "tea", 1.0), (D(2025, 1, 3), "old", 1.0)], SALES)
    assert rows(bom.recipe_requirements(sold, t), "Date", "Raw_Material") == [
        (D(2025, 1, 1), "leaf", 4.0),
        (D(2025, 1, 2), "bare", 4.0), (D(2025, 1, 2), "leaf", 6.0), (D(2025, 1, 2), "water", 3.0)]


def test_recipe_fallback_takes_all_variants(spark):
    t = recipe_schema(spark)
    t["recipe_lines"] = t["recipe_lines"].where("product_id = 1")
    sold = spark.createDataFrame([(D(2025, 1, 1), "tea", 3.0)], SALES)
    assert rows(bom.recipe_requirements(sold, t)) == [(D(2025, 1, 1), "leaf", 6.0)]


def test_flattened_tables(spark):
    t = recipe_schema(spark)
    assert rows(bom.flatten_menu(t), "Bahan") == [
        ("Uncategorized", "Tea", "bare", "4", "gr"), ("Drinks", "Tea Hot", "leaf", "2", "gr"),
        ("Uncategorized", "Tea", "syrup", "1", "gr"), ("Uncategorized", "Tea", "water", "3", "")]
    assert rows(bom.flatten_condiments(t), "Sub_Ingredient") == [
        ("syrup", 0.0, "gr", "bare", 1.0, None), ("syrup", 0.0, "gr", "leaf", 6.0, "gr")]


def basket_lines(spark):
    """Small baskets, and one receipt that holds a third of all lines."""
    data = [(i, x) for i in range(200) for x in ("ab" if i % 2 else "bc" if i % 3 else "acd")]
    data += [(999, x) for x in itertools.islice(itertools.cycle("abcdef"), len(data) // 2)]
    return data, spark.createDataFrame(data, "`Receipt number` long, Item string")


def test_pair_rules_against_counting(spark):
    data, df = basket_lines(spark)
    baskets = {}
    for receipt, item in data:
        baskets.setdefault(receipt, set()).add(item)
    n = len(baskets)
    count = lambda *items: sum(set(items) <= b for b in baskets.values())
    found = {
        (r["antecedents"][0], r["consequents"][0]): r
        for r in rules.association_rules(df, 0.1, 0.0).collect() if len(r["antecedents"]) == 1
    }
    longer = [r for r in rules.association_rules(df, 0.1, 0.0).collect() if len(r["antecedents"]) > 1]
    sets = [c for k in range(3, 7) for c in itertools.combinations("abcdef", k) if count(*c) >= 0.1 * n]
    assert {(*r["antecedents"], r["consequents"][0]) for r in longer} == {(*[x for x in c if x != y], y) for c in sets for y in c}
    expected = {p for p in itertools.permutations("abcdef", 2) if count(*p) >= 0.1 * n}
    assert set(found) == expected
    for (a, b), r in found.items():
        assert r["support"] == pytest.approx(count(a, b) / n)
        assert r["confidence"] == pytest.approx(count(a, b) / count(a))
        assert r["lift"] == pytest.approx(count(a, b) * n / (count(a) * count(b)))
        assert r["leverage"] == pytest.approx(count(a, b) / n - count(a) * count(b) / n**2)


def test_rules_for_items_limit_comes_first(spark):
    data = [(f"a{i}", f"c{i}", 0.5, 0.5, 2.0 - i / 1000) for i in range(150)]
    stored = spark.createDataFrame(data, "antecedents string, consequents string, support double, confidence double, lift double")
    wanted = spark.createDataFrame([("c5",), ("c140",)], "item string")
    assert [r["consequents"] for r in rules.rules_for_items(stored, wanted).collect()] == ["c5"]
    assert rules.rules_for_items(stored, wanted.limit(0)).count() == 0
    blank = stored.withColumn("consequents", F.lit("{}"))
    assert rules.rules_for_items(blank, wanted).count() == 100


def test_frequent_sets_of_every_length_by_brute_force(spark):
    """Equal baskets, one huge receipt, null receipts and items; sets of up to five items."""
    made = random.Random(8)
    baskets = [made.sample(range(9), made.randrange(1, 7)) for _ in range(120)] + [[1, 3, 5, 7, 8]] * 30 + [list(range(300))]
    data = [(b, f"i{x}") for b, items in enumerate(baskets) for x in items * 2] + [(None, "i1"), (None, "i3"), (5000, None)]
    df = spark.createDataFrame(data, "`Receipt number` long, Item string")
    baskets.append([1, 3])
    want = {}
    for size in range(1, 10):
        for held in itertools.combinations(range(9), size):
            n = sum(set(held) <= set(b) for b in baskets)
            if n >= 0.1 * len(baskets):
                want[tuple(f"i{x}" for x in held)] = n
    found, number = rules.frequent_itemsets(df, 0.1)
    got = rows(found)
    assert number == len(baskets) and max(map(len, want)) == 5
    assert {tuple(items): n for items, n in got} == want and len(got) == len(want)
    # Remainders that are equal travel as one row.
    rest = spark.createDataFrame([(0, [1, 2], 1)] * 3 + [(0, [1], 4), (1, [1, 2], 2)], "within long, more array<long>, times long")
    assert rows(rules._merged(rest), "within") == [(0, [1, 2], 3), (1, [1, 2], 2)]
    assert rows(rules.association_rules(df.where("Item IS NULL"), 0.1, 0.0)) == []

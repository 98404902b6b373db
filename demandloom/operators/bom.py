"""Bill of materials: flattening the recipe schema and turning item demand into material needs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.numeric import safe_float, safe_ratio
from demandloom.functions.text import material_name, name_key, product_variant_name
from demandloom.session import materialise, spread

MAX_DEPTH = 64


class BomCycleError(ValueError):
    """A condiment contains itself, directly or through others."""


def _edges(condiment_bom: DataFrame, line: str | None) -> DataFrame:
    """parent, child, amount of child in one unit of parent; lines without a number are skipped, as are
    condiments whose batch quantity is zero (``batches_of_nothing`` reports them).

    The batch quantity is the one on the condiment's first line.
    """
    order = F.col(line) if line else F.col("Sub_Ingredient")
    batch = condiment_bom.groupBy("Condiment").agg(
        F.min_by(safe_float(F.col("Condiment_Qty")), order).alias("batch")
    )
    return (
        condiment_bom.withColumn("amount", safe_float(F.col("Qty_per_condiment_unit")))
        .where(F.col("amount").isNotNull())
        .join(batch, "Condiment")
        .groupBy(F.col("Condiment").alias("parent"), F.col("Sub_Ingredient").alias("child"))
        .agg(F.sum(safe_ratio(F.col("amount"), F.col("batch"))).alias("rate"))
        .where(F.col("rate").isNotNull())
    )


def batches_of_nothing(condiment_bom: DataFrame) -> DataFrame:
    """Condiments with a line whose batch quantity is zero or no number: such lines can't be scaled."""
    return condiment_bom.where(F.coalesce(safe_float(F.col("Condiment_Qty")), F.lit(0.0)) == 0).select("Condiment").distinct()


def unit_expansion(condiment_bom: DataFrame, line: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Condiment, Material, Unit_Qty: the leaf materials in one unit of each condiment.

    One join per level of nesting. Equal paths merge after each level, so a level never has more
    rows than (condiment, ingredient) pairs, and each level is materialised. Nesting deeper than
    ``max_depth``, or a cycle, raises instead of stopping short.
    """
    edges = materialise(_edges(condiment_bom, line))
    names = condiment_bom.select(F.col("Condiment").alias("child")).distinct()
    steps = edges.select(F.col("parent").alias("node"), F.col("child").alias("next"), "rate")
    level = edges.select(F.col("parent").alias("root"), "child", F.col("rate").alias("qty"))
    levels = [level]
    for _ in range(max_depth):
        level = materialise(
            level.join(steps, F.col("child") == F.col("node"))
            .groupBy("root", F.col("next").alias("child"))
            .agg(F.sum(F.col("qty") * F.col("rate")).alias("qty"))
        )
        state = level.agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("root") == F.col("child"), F.col("root"))).alias("loop")
        ).first()
        if state["loop"] is not None:
            raise BomCycleError(f"condiment contains itself: {state['loop']}")
        if state["rows"] == 0:
            break
        levels.append(level)
    else:
        raise BomCycleError(f"condiments nest deeper than {max_depth} levels")
    return (
        reduce(DataFrame.unionByName, levels)
        .join(names, "child", "left_anti")
        .groupBy(F.col("root").alias("Condiment"), F.col("child").alias("Material"))
        .agg(F.sum("qty").alias("Unit_Qty"))
    )


def item_lines(menu_bom: DataFrame, line: str | None = None) -> DataFrame:
    """key, Bahan, per_unit: recipe lines by normalised item name.

    Where spellings of one name collide, only the lines of the spelling listed last count.
    """
    order = F.min(line) if line else F.max("Item")
    spelling = (
        menu_bom.withColumn("key", name_key(F.col("Item")))
        .groupBy("key", "Item")
        .agg(order.alias("listed"))
        .groupBy("key")
        .agg(F.max_by("Item", "listed").alias("Item"))
    )
    return (
        menu_bom.withColumn("per_unit", safe_float(F.col("Qty")))
        .where(F.col("per_unit").isNotNull())
        .join(spelling, "Item")
        .groupBy("key", "Bahan")
        .agg(F.sum("per_unit").alias("per_unit"))
    )


def item_materials(
    menu_bom: DataFrame, condiment_bom: DataFrame, menu_line: str | None = None, condiment_line: str | None = None
) -> DataFrame:
    """key, Material, per_unit: leaf materials in one unit of each item."""
    lines = item_lines(materialise(menu_bom), menu_line)
    condiment_bom = materialise(condiment_bom)
    expansion = unit_expansion(condiment_bom, condiment_line)
    names = condiment_bom.select(F.col("Condiment").alias("Bahan")).distinct()
    plain = lines.join(names, "Bahan", "left_anti").select(
        "key", F.col("Bahan").alias("Material"), "per_unit"
    )
    mixed = lines.join(expansion, F.col("Bahan") == F.col("Condiment")).select(
        "key", "Material", (F.col("per_unit") * F.col("Unit_Qty")).alias("per_unit")
    )
    return plain.unionByName(mixed).groupBy("key", "Material").agg(F.sum("per_unit").alias("per_unit"))


def _daily_demand(sales: DataFrame, quantity: str) -> DataFrame:
    """Positive demand by date and item; the expansion is linear, so it runs on the sums."""
    return (
        sales.where(F.col(quantity) > 0)
        .groupBy(F.col("Date").cast("date").alias("Date"), name_key(F.col("Item")).alias("key"))
        .agg(F.sum(quantity).alias("sold"))
    )


# Cells (dates by materials) and materials of a block, items multiplied at a time, rows from which whole items are taken.
BLOCK_CELLS, BLOCK_MATERIALS, ITEMS, ITEM_ROWS = 1 << 22, 1 << 15, 64, 1 << 17


def _needs_by_day(demand: DataFrame, needs: DataFrame, out: str, amount: str) -> DataFrame:
    """Sum of sold times per-unit need by date; ``needs`` has key, ``out`` and per_unit.

    Demand by (date, item) times recipes by (item, material) is a matrix product. It is taken by blocks of the result:
    a block has some of the dates and some of the materials, gets the demand of its dates and the recipe lines of its
    materials sorted by item, and adds them up, so what leaves it is final. Blocks have a bounded size, and dates and
    materials are cut so that the copies of demand and recipes together are few.
    """
    demand = demand.where("Date IS NOT NULL AND key IS NOT NULL")
    needs = needs.where(F.col(out).isNotNull() & F.col("key").isNotNull())
    sold, dates = demand.agg(F.count(F.lit(1)), F.count_distinct("Date")).first()
    listed, materials = needs.agg(F.count(F.lit(1)), F.count_distinct(out)).first()
    blocks = max(-(-dates * materials // BLOCK_CELLS), 2 * demand.sparkSession.sparkContext.defaultParallelism)
    parts = min(max(round((blocks * max(sold, 1) / max(listed, 1)) ** 0.5), 1), blocks)
    blocks = max(-(-blocks // parts), -(-materials // BLOCK_MATERIALS))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    date_part = F.pmod(F.datediff("Date", F.lit("1970-01-01").cast("date")), F.lit(parts)).cast("int")
    dated = demand.select(
        every(blocks).alias("block"), date_part.alias("part"), "key", "Date", F.lit(None).cast("string").alias("material"),
        F.col("sold").cast("double").alias("value"))
    recipe = needs.select(
        F.pmod(F.xxhash64(out), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), "key",
        F.lit(None).cast("date").alias("Date"), F.col(out).cast("string").alias("material"), F.col("per_unit").cast("double").alias("value"))
    both = spread(dated.unionByName(recipe), "block", "part").sortWithinPartitions("block", "part", "key")
    return both.mapInArrow(_block_sums, "Date date, material string, amount double").select(
        "Date", F.col("material").alias(out), F.col("amount").alias(amount))


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Date, material, amount of each block, from rows sorted by block and item; a cell is listed if an item links it."""
    now, cells = None, _Cells()
    for rows in _whole_items(batches):
        starts = _item_starts(rows)
        item = np.zeros(rows.num_rows, np.int64)
        item[starts[1:]] = 1
        item = np.cumsum(item)
        blocks = np.stack([rows.column(x).to_numpy()[starts] for x in ("block", "part")])
        cuts = [0, *(np.flatnonzero((blocks[:, 1:] != blocks[:, :-1]).any(axis=0)) + 1).tolist(), len(starts)]
        for low, high in zip(cuts, cuts[1:]):
            own = tuple(blocks[:, low].tolist())
            if own != now:
                yield from cells.listed()
                now, cells = own, _Cells()
            for first in range(low, high, ITEMS):
                last = min(first + ITEMS, high)
                start, end = starts[first], starts[last] if last < len(starts) else rows.num_rows
                cells.add(rows.slice(start, end - start), item[start:end] - first, last - first)
    yield from cells.listed()


def _whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in steps that cut no item of a block; its rows are bounded by the block's sides."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ITEM_ROWS:
            rows = pa.concat_batches(held)
            last = int(_item_starts(rows)[-1])
            if last:
                yield rows.slice(0, last)
            held, size = [rows.slice(last)], rows.num_rows - last
    if size:
        yield pa.concat_batches(held)


def _item_starts(rows: pa.RecordBatch) -> np.ndarray:
    codes = [rows.column("key").dictionary_encode().indices.to_numpy(), *(rows.column(x).to_numpy() for x in ("block", "part"))]
    return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in codes], axis=0)))


class _Cells:
    """Sums by date and material, as far as they are seen."""

    def __init__(self):
        self.dates: dict[int, int] = {}
        self.materials: dict[str, int] = {}
        self.sums = np.zeros((0, 0))
        self.linked = np.zeros((0, 0), bool)

    def add(self, rows: pa.RecordBatch, item: np.ndarray, n: int) -> None:
        """The demand and the recipe lines of ``n`` items, whole."""
        days, names = rows.column("Date"), rows.column("material").dictionary_encode()
        values, of_demand = rows.column("value").to_numpy(zero_copy_only=False), days.is_valid().to_numpy(zero_copy_only=False)
        if of_demand.all() or not of_demand.any():
            return
        found, day = np.unique(days.filter(pa.array(of_demand)).cast(pa.int32()).to_numpy(), return_inverse=True)
        material = names.indices.filter(pa.array(~of_demand)).to_numpy()
        sold, dated = np.zeros((len(found), n)), np.zeros((len(found), n), np.float32)
        np.add.at(sold, (day, item[of_demand]), values[of_demand])
        dated[day, item[of_demand]] = 1
        made, listed = np.zeros((n, len(names.dictionary))), np.zeros((n, len(names.dictionary)), np.float32)
        np.add.at(made, (item[~of_demand], material), values[~of_demand])
        listed[item[~of_demand], material] = 1
        at = np.ix_(_placed(self.dates, found.tolist()), _placed(self.materials, names.dictionary.to_pylist()))
        shape = tuple(max(have, -(-want // 256) * 256) for have, want in zip(self.sums.shape, (len(self.dates), len(self.materials))))
        if shape != self.sums.shape:
            grown = [(0, new - old) for new, old in zip(shape, self.sums.shape)]
            self.sums, self.linked = np.pad(self.sums, grown), np.pad(self.linked, grown)
        self.sums[at] += sold @ made
        self.linked[at] |= dated @ listed > 0

    def listed(self) -> Iterator[pa.RecordBatch]:
        dates, names = np.array(list(self.dates), np.int32), pa.array(list(self.materials), pa.string())
        for row, day in enumerate(dates):
            material = np.flatnonzero(self.linked[row])
            if len(material):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(material), day)).cast(pa.date32()), names.take(pa.array(material)), pa.array(self.sums[row][material])],
                    names=["Date", "material", "amount"])


def _placed(places: dict, values: list) -> list[int]:
    return [places.setdefault(x, len(places)) for x in values]


def explode_level_one(sales: DataFrame, menu_bom: DataFrame, quantity: str = "Quantity") -> DataFrame:
    """Direct ingredients by date; items without a recipe contribute nothing."""
    return _needs_by_day(_daily_demand(sales, quantity), item_lines(menu_bom), "Bahan", "Qty")


def items_without_recipe(sales: DataFrame, menu_bom: DataFrame) -> DataFrame:
    names = sales.select("Item", name_key(F.col("Item")).alias("key")).distinct()
    return names.join(item_lines(menu_bom), "key", "left_anti").select("Item")


def material_requirements(
    sales: DataFrame,
    menu_bom: DataFrame,
    condiment_bom: DataFrame,
    quantity: str = "Quantity",
    menu_line: str | None = None,
    condiment_line: str | None = None,
) -> DataFrame:
    """Date, Raw_Material, Quantity_Required."""
    needs = item_materials(menu_bom, condiment_bom, menu_line, condiment_line)
    named = needs.groupBy("key", material_name(F.col("Material")).alias("Raw_Material")).agg(
        F.sum("per_unit").alias("per_unit"))
    return _needs_by_day(_daily_demand(sales, quantity), named, "Raw_Material", "Quantity_Required")


def top_materials(requirements: DataFrame, n: int = 20) -> DataFrame:
    return (
        requirements.groupBy("Raw_Material")
        .agg(F.sum("Quantity_Required").alias("Quantity_Required"))
        .orderBy(F.desc("Quantity_Required"), "Raw_Material")
        .limit(n)
    )


# --- the normalised recipe schema ------------------------------------------------------------


def _active(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def flatten_menu(t: dict[str, DataFrame]) -> DataFrame:
    """Tipe, Item, Bahan, Qty, Unit from the recipe tables; inactive parts are left out."""
    products = t["products"].where(_active("is_active")).select(
        F.col("id").alias("product_id"), F.col("name").alias("product"))
    variants = t["variants"].select(
        F.col("id").alias("variant_id"), F.col("name").alias("variant"), F.col("is_active").alias("v_active"))
    materials = t["materials"].select(
        F.col("id").alias("material_id"), F.col("name").alias("material"),
        F.col("unit_id").alias("m_unit"), F.col("is_active").alias("m_active"))
    condiments = t["condiments"].select(
        F.col("id").alias("condiment_id"), F.col("name").alias("condiment"), F.col("unit_id").alias("c_unit"))
    units = t["units"]
    m_units = units.select(F.col("id").alias("m_unit"), F.col("code").alias("m_code"))
    c_units = units.select(F.col("id").alias("c_unit"), F.col("code").alias("c_code"))
    categories = t["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    joined = (
        t["recipe_lines"].join(products, "product_id")
        # The key of a left join is missing exactly where its row is, so these tests read "row
        # absent or active".
        .join(variants.withColumn("has_variant", F.lit(True)), "variant_id", "left")
        .where(F.col("has_variant").isNull() | _active("v_active"))
        .join(materials.withColumn("has_material", F.lit(True)), "material_id", "left")
        .where(F.col("has_material").isNull() | _active("m_active"))
        .join(condiments, "condiment_id", "left")
        .join(t["category_links"], "product_id", "left")
        .join(categories, "category_id", "left")
        .join(m_units, "m_unit", "left")
        .join(c_units, "c_unit", "left")
    )
    return joined.select(
        F.coalesce("category", F.lit("Uncategorized")).alias("Tipe"),
        product_variant_name(F.col("product"), F.col("variant")).alias("Item"),
        F.coalesce("material", "condiment").alias("Bahan"),
        F.col("quantity").alias("Qty"),
        F.coalesce("m_code", "c_code", F.lit("")).alias("Unit"),
    )


def flatten_condiments(t: dict[str, DataFrame]) -> DataFrame:
    """Condiment lines with units; a sub-unit is looked up only for material lines."""
    condiments = t["condiments"]
    owner = condiments.select(
        F.col("id").alias("condiment_id"), F.col("name").alias("Condiment"),
        F.col("batch_quantity").alias("Condiment_Qty"), F.col("unit_id").alias("c_unit"))
    child = condiments.select(F.col("id").alias("child_condiment_id"), F.col("name").alias("child"))
    materials = t["materials"].select(
        F.col("id").alias("material_id"), F.col("name").alias("material"), F.col("unit_id").alias("m_unit"))
    units = t["units"]
    c_units = units.select(F.col("id").alias("c_unit"), F.col("code").alias("Condiment_Unit"))
    m_units = units.select(F.col("id").alias("m_unit"), F.col("code").alias("Sub_Unit"))
    return (
        t["condiment_lines"].join(owner, "condiment_id")
        .join(c_units, "c_unit", "left")
        .join(materials, "material_id", "left")
        .join(child, "child_condiment_id", "left")
        .join(m_units, "m_unit", "left")
        .select(
            "Condiment", "Condiment_Qty", "Condiment_Unit",
            F.coalesce("material", "child").alias("Sub_Ingredient"),
            F.col("quantity").alias("Qty_per_condiment_unit"), "Sub_Unit",
        )
    )


def recipe_requirements(forecast: DataFrame, t: dict[str, DataFrame], quantity: str = "Quantity") -> DataFrame:
    """Material needs through the recipe schema.

    An item matches product plus variant; only items without such a match fall back to the product
    name, with the lines of all its variants. Condiments expand one level; one without lines passes
    through under its own name.
    """
    products = t["products"].where(_active("is_active")).select(
        F.col("id").alias("product_id"), F.col("name").alias("product"))
    variants = t["variants"].select(F.col("id").alias("variant_id"), F.col("name").alias("variant"))
    materials = t["materials"].select(F.col("id").alias("material_id"), F.col("name").alias("material"))
    condiments = t["condiments"].select(
        F.col("id").alias("condiment_id"), F.col("name").alias("condiment"))
    lines = (
        t["recipe_lines"].join(products, "product_id")
        .join(variants, "variant_id", "left")
        .select(
            F.lower("product").alias("product_key"),
            F.lower(product_variant_name(F.col("product"), F.col("variant"), None)).alias("item_key"),
            "material_id", "condiment_id", safe_float(F.col("quantity"), 0.0).alias("qty"),
        )
    )

    # Read twice: for the names sold, and for the amounts.
    demand = materialise(
        forecast.groupBy(F.col("Date").cast("date").alias("Date"), F.lower("Item").alias("key"))
        .agg(F.sum(safe_float(F.col(quantity), 0.0)).alias("sold"))
    )
    names = demand.select("key").distinct()
    exact = lines.select(F.col("item_key").alias("key")).distinct().withColumn("exact", F.lit(True))
    wanted = materialise(names.join(exact, "key", "left").select("key", F.coalesce("exact", F.lit(False)).alias("exact")))
    keys = F.explode(F.array(*[
        F.struct(F.col(key).alias("key"), F.lit(own).alias("exact")) for key, own in (("item_key", True), ("product_key", False))]))
    recipes = materialise(
        lines.select(keys.alias("x"), "material_id", "condiment_id", "qty").select("x.*", "material_id", "condiment_id", "qty")
        .groupBy("key", "exact", "material_id", "condiment_id").agg(F.sum("qty").alias("qty"))
        .join(wanted, ["key", "exact"], "left_semi")
    )

    batch = t["condiments"].select(
        F.col("id").alias("condiment_id"), F.col("name").alias("condiment"),
        F.coalesce(F.nullif(F.col("batch_quantity"), F.lit(0.0)), F.lit(1.0)).alias("batch"))
    inner = (
        t["condiment_lines"].join(batch, "condiment_id")
        .join(materials, "material_id", "left")
        .groupBy("condiment", F.col("material").alias("sub"))
        .agg(F.sum(F.col("quantity").cast("double") / F.col("batch")).alias("rate"))
    )
    direct = recipes.join(materials, "material_id").select(_side("item", "key"), F.col("material").alias("Raw_Material"), F.col("qty").alias("per_unit"))
    # Condiments are summed by day first and expanded once, not in the recipe of every item.
    mixed = recipes.join(condiments, "condiment_id").groupBy("key", "condiment").agg(F.sum("qty").alias("per_unit"))
    through = (
        mixed.select("condiment").where(F.col("condiment").isNotNull()).distinct()
        .join(inner, "condiment", "left")
        # A condiment with lines but no material on a line loses that line.
        .where(F.col("sub").isNotNull() | F.col("rate").isNull())
        .select(_side("condiment", "condiment"), F.coalesce("sub", "condiment").alias("Raw_Material"),
                F.coalesce("rate", F.lit(1.0)).alias("per_unit"))
    )
    poured = materialise(_needs_by_day(demand, mixed, "condiment", "sold"))
    asked = demand.select("Date", _side("item", "key"), "sold").unionByName(poured.select("Date", _side("condiment", "condiment"), "sold"))
    return _needs_by_day(asked, direct.unionByName(through), "Raw_Material", "Quantity_Required")


def _side(kind: str, name: str) -> Column:
    """Key of an item or a condiment: the two may share a name."""
    return F.concat(F.lit(f"{kind}:"), F.col(name)).alias("key")

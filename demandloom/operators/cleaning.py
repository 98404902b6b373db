"""Receipts: merging dialects, item-name standardisation and removal of discontinued items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions import text
from demandloom.functions.dates import parse_receipt_time
from demandloom.functions.numeric import scrub_number
from demandloom.schemas import (
    INDONESIAN_HEADERS, INDONESIAN_VALUES, RECEIPT_COLUMNS, RECEIPT_NUMBERS,
)
from demandloom.sources.files import read_csv

# Old item name (lower case) to the name on the menu.
ITEM_RENAMES = {
    "lemon tea hot": "Lemon Tea Hot",
    "lemon tea ice": "Lemon Tea Ice",
    "lemon ice": "Lemon Tea Ice",
    "lemon hot": "Lemon Tea Hot",
    "lemon tea": "Lemon Tea Hot",
    "milk tea hot": "Mewangi Milk Tea Hot",
    "milk tea ice": "Mewangi Milk Tea Ice",
    "mewangi milk tea": "Mewangi Milk Tea Hot",
    "lychee tea hot": "Lychee Tea Hot",
    "lychee tea ice": "Lychee Tea Ice",
    "lychee tea": "Lychee Tea Hot",
    "kopi susu panas": "Kopi Susu Husgendam Hot",
    "kopi susu hot": "Kopi Susu Husgendam Hot",
    "kopi susu ice": "Kopi Susu Husgendam Ice",
    "kopi susu bersemi": "Kopi Susu Husgendam Hot",
    "kopi susu bersemi ice": "Kopi Susu Husgendam Ice",
    "kopi susu bersemi hot": "Kopi Susu Husgendam Hot",
    "kopi susu husgendam": "Kopi Susu Husgendam Hot",
    "husgendam hot": "Kopi Susu Husgendam Hot",
    "husgendam ice": "Kopi Susu Husgendam Ice",
    "husgen platter": "Husgendam Platter",
    "husgendam platter": "Husgendam Platter",
    "husgendam toast": "Husgendam Platter",
    "husgendam nugget": "Husgendam Platter",
    "long black hot": "Black Hot",
    "long black ice": "Black Ice",
    "americano hot": "Black Hot",
    "americano ice": "Black Ice",
    "ice cappucino": "Cappucino Ice",
    "latte": "Latte Hot",
    "ice latte": "Latte Ice",
    "susu coklat": "Chocolate Hot",
    "coklat hot": "Chocolate Hot",
    "coklat ice": "Chocolate Ice",
    "coklat": "Chocolate Hot",
    "tubruk susu": "Tubruk",
    "picolo": "Espresso",
    "piccolo": "Espresso",
    "v60 hacienda natural": "Filter",
    "v60 argopuro": "Filter",
    "v60 finca": "Filter",
    "v60 - ijen classic washed hot": "Filter",
    "v60 - ijen classic washed ice": "Filter",
    "v60 - strawberry twist hot": "Filter",
    "v60 - strawberry twist ice": "Filter",
    "filter - ijen classic washed hot": "Filter",
    "filter - ijen classic washed ice": "Filter",
    "filter - semendo liberika hsn hot": "Filter",
    "filter - semendo liberika hsn ice": "Filter",
    "filter - sinapeul black honey hot": "Filter",
    "filter - sinapeul black honey ice": "Filter",
    "filter - strawberry twist hot": "Filter",
    "filter - strawberry twist ice": "Filter",
    "mie goreng telur": "Mie Goreng",
    "mie rebus telur": "Mie Rebus",
    "nasi goreng djawa": "Nasi Goreng Jawa",
    "nasi ayam daun jeruk": "Nasi Ayam Daun Jeruk",
    "ayam daun jeruk": "Nasi Ayam Daun Jeruk",
    "ayam mentega (paket)": "Nasi Ayam Mentega",
    "ayam curry (paket)": "Nasi Ayam Curry",
    "ayam dauh jeruk (paket)": "Nasi Ayam Daun Jeruk",
    "ayam curry": "Nasi Ayam Curry",
    "ayam mentega": "Nasi Ayam Mentega",
    "ayam chili padi": "Nasi Ayam Chili Padi",
    "cireng isi": "Cireng",
    "kentang goreng": "Kentang",
    "kentang": "Kentang",
    "pisang goreng": "Pisang Goreng Madu",
    "pisang goreng aren": "Pisang Goreng Madu",
    "pisang goreng madu": "Pisang Goreng Madu",
    "puspha matcha": "Puspa Matcha",
    "puspa matcha": "Puspa Matcha",
    "original cookie": "Cookies Original",
    "cookies original": "Cookies Original",
    "waffle vanilla": "Candana Vanilla",
    "waffle strawberry": "Kirana Strawberry",
    "waffle matcha": "Puspa Matcha",
    "memukau (for him)": "Memukau",
    "menawan (for her)": "Menawan",
    "cheese cake": "New York Cheesecake",
    "cheesecake": "New York Cheesecake",
    "pannacotta": "New York Cheesecake",
    "panacotta": "New York Cheesecake",
    "air mineral besar": "Air Mineral",
    "filter strw": "Filter",
    "filter ethiopia": "Filter",
    "filter kenya": "Filter",
    "filter flores mewangi": "Filter",
    "filter kamojang kembang": "Filter",
    "filter coffe abhimanyu": "Filter",
}
# Package name to its components and their quantity multipliers.
PACKAGES = {
    "mie goreng telur": (("Mie Goreng", 1.0), ("Add Telur", 1.0)),
    "mie rebus telur": (("Mie Rebus", 1.0), ("Add Telur", 1.0)),
    "paket ayam teriyaki + lemon tea": (("Ayam Teriyaki", 1.0), ("Lemon Ice", 1.0)),
    "paket ayam curry + lemon tea": (("Ayam Curry", 1.0), ("Lemon Ice", 1.0)),
}


def _lookup(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


# --- receipt files ---------------------------------------------------------------------------


def translate_headers(df: DataFrame, names: Mapping[str, str] = INDONESIAN_HEADERS) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def translate_values(
    df: DataFrame, values: Mapping[str, Mapping[str, str]] = INDONESIAN_VALUES
) -> DataFrame:
    """Replace known cell values; others stay."""
    return df.withColumns({
        name: F.coalesce(_lookup(mapping)[F.col(f"`{name}`")], F.col(f"`{name}`"))
        for name, mapping in values.items()
        if name in df.columns and mapping
    })


def canonical_receipts(df: DataFrame) -> DataFrame:
    """Numbers and dates parsed, canonical columns in order; absent ones NULL, extra ones gone."""
    present = set(df.columns)

    def column(name: str) -> Column:
        if name not in present:
            kind = "timestamp" if name == "Date" else "double" if name in RECEIPT_NUMBERS else "string"
            return F.lit(None).cast(kind).alias(name)
        cell = F.col(f"`{name}`")
        if name == "Date":
            return parse_receipt_time(cell).alias(name)
        if name in RECEIPT_NUMBERS:
            return scrub_number(cell).alias(name)
        return cell.cast("string").alias(name)

    return df.select(*[column(name) for name in RECEIPT_COLUMNS])


def union_receipts(frames: Sequence[DataFrame], drop_repeats: bool = False) -> DataFrame:
    """Union of canonical receipts; overlapping files keep their repeats unless asked otherwise."""
    merged = reduce(DataFrame.unionByName, frames)
    return merged.dropDuplicates() if drop_repeats else merged


def merge_receipt_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """First file ``;``-separated with translated headers, the others comma-separated English.

    Fewer than two paths give nothing.
    """
    if len(paths) < 2:
        return None
    first = translate_values(translate_headers(read_csv(spark, paths[0], sep=";")))
    others = [read_csv(spark, path) for path in paths[1:]]
    merged = union_receipts([canonical_receipts(df) for df in (first, *others)])
    return merged.orderBy(F.col("Date").asc_nulls_last())


# --- item names ------------------------------------------------------------------------------


def apply_modifiers(df: DataFrame) -> DataFrame:
    if "Modifiers applied" not in df.columns:
        return df
    return df.withColumn("Item", text.with_modifier(F.col("Item"), F.col("`Modifiers applied`")))


def rename_items(df: DataFrame, renames: Mapping[str, str] = ITEM_RENAMES) -> DataFrame:
    """Case-insensitive exact rename (no trimming), as one literal map in the projection."""
    if not renames:
        return df
    table = {old.lower(): new for old, new in renames.items()}
    return df.withColumn("Item", F.coalesce(_lookup(table)[F.lower("Item")], F.col("Item")))


def menu_keys(menu: DataFrame) -> DataFrame:
    """One spelling per normalised menu name."""
    return (
        menu.where(F.col("Item").isNotNull())
        .groupBy(text.name_key(F.col("Item")).alias("key"))
        .agg(F.max(F.trim("Item")).alias("spelling"))
    )


def case_to_menu(df: DataFrame, menu: DataFrame) -> DataFrame:
    """Menu spelling where only the case or the outer blanks differ."""
    keys = menu_keys(menu)
    return (
        df.join(keys, text.name_key(F.col("Item")) == F.col("key"), "left")
        .withColumn("Item", F.coalesce("spelling", "Item"))
        .drop("key", "spelling")
    )


def suffix_lookup(menu: DataFrame) -> DataFrame:
    """``base`` to ``Matched`` for names off the menu that are on it with `` Hot`` or `` Ice``.

    Hot wins when both exist, unless the name itself ends in `` ice``. The table comes from the menu
    alone, so no pass over the lines collects their names.
    """
    keys = menu_keys(menu)
    ending = F.right("key", F.lit(4))
    suffixed = keys.where(ending.isin(" hot", " ice")).select(
        F.expr("left(key, length(key) - 4)").alias("base"), ending.alias("ending"), "spelling"
    )
    per_base = suffixed.groupBy("base").agg(
        F.max(F.when(F.col("ending") == " hot", F.col("spelling"))).alias("hot"),
        F.max(F.when(F.col("ending") == " ice", F.col("spelling"))).alias("ice"),
    )
    iced = F.col("base").endswith(" ice")
    matched = F.when(iced, F.coalesce("ice", "hot")).otherwise(F.coalesce("hot", "ice"))
    return per_base.join(
        keys.select(F.col("key").alias("base")), "base", "left_anti"
    ).select("base", matched.alias("Matched"))


def suffix_match(df: DataFrame, menu: DataFrame) -> DataFrame:
    """Resolve names that only miss their `` Hot`` or `` Ice``."""
    return (
        df.join(suffix_lookup(menu), text.name_key(F.col("Item")) == F.col("base"), "left")
        .withColumn("Item", F.coalesce("Matched", "Item"))
        .drop("base", "Matched")
    )


def standardise_names(
    df: DataFrame,
    menu: DataFrame,
    renames: Mapping[str, str] = ITEM_RENAMES,
    fragment: str = "v60",
    target: str = "Filter",
) -> DataFrame:
    """Modifiers, renames, menu case, pattern collapse and suffixes, in that order."""
    named = rename_items(apply_modifiers(df), renames)
    cased = case_to_menu(named, menu)
    collapsed = cased.withColumn("Item", text.collapse_pattern(F.col("Item"), fragment, target))
    return suffix_match(collapsed, menu)


def expand_packages(
    df: DataFrame, packages: Mapping[str, Sequence[tuple[str, float]]] = PACKAGES
) -> DataFrame:
    """One line per component of a package, quantities multiplied; other lines pass."""
    components = F.create_map(*[
        part
        for name, parts in packages.items()
        for part in (
            F.lit(name.lower()),
            F.array(*[F.struct(F.lit(i).alias("item"), F.lit(float(m)).alias("times")) for i, m in parts]),
        )
    ])
    itself = F.array(F.struct(F.col("Item").alias("item"), F.lit(1.0).alias("times")))
    return (
        df.withColumn("_part", F.explode(F.coalesce(components[F.lower("Item")], itself)))
        .withColumns({
            "Item": F.col("_part.item"),
            "Quantity": F.col("Quantity") * F.col("_part.times"),
        })
        .drop("_part")
    )


# --- discontinued items ----------------------------------------------------------------------


def keep_active(df: DataFrame, menu: DataFrame, remove: bool = True) -> DataFrame:
    """Lines whose item is on the menu; lines without an item always stay."""
    if not remove:
        return df
    key = text.name_key(F.col("Item"))
    # The blank key stands for a missing name, which is never discontinued.
    kept = menu_keys(menu).select("key").union(df.sparkSession.range(1).select(F.lit("").alias("key"))).distinct()
    return df.join(kept, key == F.col("key"), "left_semi")


def discontinued_report(df: DataFrame, menu: DataFrame) -> DataFrame:
    """Per discontinued item: quantity, lines, first and last sale. Lines aggregate before the join."""
    per_item = df.where(F.col("Item").isNotNull()).groupBy("Item").agg(
        F.sum("Quantity").alias("Total_Quantity_Sold"),
        F.count(F.lit(1)).alias("Total_Transactions"),
        F.min("Date").alias("First_Sale_Date"),
        F.max("Date").alias("Last_Sale_Date"),
    )
    key = text.name_key(F.col("Item"))
    return per_item.where(key != "").join(menu_keys(menu), key == F.col("key"), "left_anti")


def cleaning_stats(df: DataFrame, menu: DataFrame, renames: Mapping[str, str] = ITEM_RENAMES) -> DataFrame:
    """Lines read, renamed and removed, and items discontinued, from one pass over the lines."""
    hit = F.lower("Item").isin(*[old.lower() for old in renames])
    per_item = (
        apply_modifiers(df)
        .withColumn("_hit", hit.cast("long"))
        .transform(lambda d: rename_items(d, renames))
        .groupBy("Item")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("_hit").alias("renamed"))
    )
    marked = per_item.join(
        menu_keys(menu).withColumn("known", F.lit(1)), text.name_key(F.col("Item")) == F.col("key"), "left"
    ).withColumn("gone", (F.col("known").isNull() & (text.name_key(F.col("Item")) != "")).cast("long"))
    return marked.agg(
        F.sum("lines").alias("original_records"),
        F.coalesce(F.sum("renamed"), F.lit(0)).alias("renamed_records"),
        F.sum("gone").alias("discontinued_items"),
        F.sum(F.col("lines") * F.col("gone")).alias("removed_records"),
    )


def exclude_items(df: DataFrame, prefix: str = "add", fragment: str | None = "cheese cake") -> DataFrame:
    """Drop modifier lines (by name prefix) and one retired item (by name fragment)."""
    kept = df.where(~text.has_prefix(F.col("Item"), prefix))
    return kept if fragment is None else kept.where(~F.lower("Item").contains(fragment))


def consolidate(df: DataFrame, pattern: str = r"(?i)^espresso bon-bon$", target: str = "espresso") -> DataFrame:
    return df.withColumn("Item", F.regexp_replace(F.trim("Item"), pattern, target))


def snake_case_sales(df: DataFrame) -> DataFrame:
    """Receipts as the ``sales_cleaned`` table: snake case, numbers coerced, blanks NULL."""

    def cell(name: str) -> Column:
        alias = name.lower().replace(" ", "_")
        if name == "Date":
            return F.col(name).cast("timestamp_ntz").alias("date")
        if name in RECEIPT_NUMBERS:
            return F.col(f"`{name}`").cast("string").try_cast("double").alias(alias)
        value = F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))
        # The text "nan" is how a missing cell looks after a round trip through CSV.
        return F.nullif(value, F.lit("nan")).alias(alias)

    return df.select(*[cell(name) for name in RECEIPT_COLUMNS if name in df.columns])

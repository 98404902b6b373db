"""Item and material names, and rule text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: materials written as acronyms.
MATERIAL_ACRONYMS = ("SKM", "BSJ", "SP")


def name_key(name: Column) -> Column:
    """Comparison form of an item name: trimmed, lower case, NULL as empty text."""
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def has_prefix(name: Column, prefix: str = "add") -> Column:
    return F.lower(F.trim(name)).startswith(prefix)


def with_modifier(name: Column, modifier: Column) -> Column:
    """Append `` Hot`` or `` Ice`` when the modifier says so and the name has neither ending."""
    key = F.lower(F.trim(name))
    bare = ~(key.endswith(" hot") | key.endswith(" ice"))
    wanted = F.trim(modifier)
    return F.when(
        wanted.isin("Hot", "Ice") & bare, F.concat(F.trim(name), F.lit(" "), wanted)
    ).otherwise(name)


def collapse_pattern(name: Column, fragment: str = "v60", target: str = "Filter") -> Column:
    return F.when(F.lower(name).contains(fragment), F.lit(target)).otherwise(name)


def title_case(text: Column) -> Column:
    """Capital after every character that is not a letter, small letters otherwise."""
    # initcap starts words at blanks only, so each other break gets a marked blank for the moment.
    marked = F.regexp_replace(F.lower(text), r"([^\p{L} ])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def material_name(name: Column) -> Column:
    """Acronyms in capitals, everything else in title case."""
    trimmed = F.trim(name)
    upper = F.upper(trimmed)
    return F.when(upper.isin(*MATERIAL_ACRONYMS), upper).otherwise(title_case(trimmed))


def product_variant_name(product: Column, variant: Column, bare_variant: str | None = "default") -> Column:
    """Product and variant in one name; ``bare_variant`` counts as no variant."""
    named = variant.isNotNull() & (variant != "")
    if bare_variant is not None:
        named = named & (variant != bare_variant)
    return F.when(named, F.concat_ws(" ", product, variant)).otherwise(product)


def single_item_of_set_text(text: Column) -> Column:
    """``frozenset({'X'})`` becomes ``X``; text of any other form is kept."""
    inner = F.regexp_extract(text, r"'([^']+)'\}", 1)
    return F.when(inner != "", inner).otherwise(text)


def items_of_rule_text(text: Column) -> Column:
    """Item list from rule text: brackets and quotes dropped, split on commas, lower case."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[{}\\[\\]()'\"]", "")
    parts = F.transform(F.split(bare, ","), lambda part: F.lower(F.trim(part)))
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def items_of_json_text(text: Column) -> Column:
    """Item list from a JSON array; text that does not parse gives an empty list."""
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    parts = F.transform(parsed, lambda part: F.lower(F.trim(part)))
    return F.array_distinct(F.filter(parts, lambda part: part.isNotNull() & (part != "")))

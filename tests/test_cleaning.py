"""Receipt files, name standardisation and discontinued items."""

import datetime as dt

from pyspark.sql import functions as F

from demandloom.operators import aggregates, cleaning
from demandloom.schemas import RECEIPT_COLUMNS
from helpers import D, rows


def menu(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "Item string")


def lines(spark, *data):
    return spark.createDataFrame(
        list(data), "Date date, Item string, `Modifiers applied` string, Quantity double")


def test_merge_receipt_files(spark, tmp_path):
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text("Tanggal;Barang;Kuantitas;Jenis struk;Penjualan bersih\n13/05/25 23.43;Kopi;2;Penjualan;Rp 10.000\njunk;Teh;-1;Lain;x\n")
    second.write_text("Date,Item,Quantity,Status,Unknown\n9/25/25 10:07 PM,Latte,3,Closed,zzz\n")
    merged = cleaning.merge_receipt_files(spark, [str(first), str(second)])
    assert merged.columns == list(RECEIPT_COLUMNS)
    got = [(r["Date"], r["Item"], r["Quantity"], r["Receipt type"], r["Net sales"]) for r in merged.collect()]
    assert got == [
        (dt.datetime(2025, 5, 13, 23, 43), "Kopi", 2.0, "Sale", 10.0),
        (dt.datetime(2025, 9, 25, 22, 7), "Latte", 3.0, None, None),
        (None, "Teh", 1.0, "Lain", None)]
    assert cleaning.merge_receipt_files(spark, [str(first)]) is None


def test_repeats_stay_unless_dropped(spark):
    one = cleaning.canonical_receipts(spark.createDataFrame([("Kopi", "2")], "Item string, Quantity string"))
    assert cleaning.union_receipts([one, one]).count() == 2
    assert cleaning.union_receipts([one, one], drop_repeats=True).count() == 1


def test_rename_map_is_one_shot(spark):
    """The literal map has no entry whose result another entry renames again."""
    renames = cleaning.ITEM_RENAMES
    assert len(renames) == 90 and len(set(renames.values())) == 37
    chained = {}
    for old in renames:
        name = old
        for source, target in renames.items():
            if name.lower() == source.lower():
                name = target
        chained[old] = name
    assert chained == renames
    df = lines(spark, (D(2025, 1, 1), "SUSU Coklat", None, 1.0), (D(2025, 1, 1), " latte", None, 1.0))
    assert {r["Item"] for r in cleaning.rename_items(df).collect()} == {"Chocolate Hot", " latte"}


def test_standardise(spark):
    m = menu(spark, "Latte Hot", "Latte Ice", "Mocha Ice", "Filter", "Black Tea")
    data = lines(
        spark, (D(2025, 1, 1), "latte", None, 1.0), (D(2025, 1, 1), "Mocha", None, 1.0),
        (D(2025, 1, 1), "V60 Special", None, 1.0), (D(2025, 1, 1), "BLACK TEA ", None, 1.0),
        (D(2025, 1, 1), "Mocha", "Ice", 1.0), (D(2025, 1, 1), None, None, 1.0), (D(2025, 1, 1), "Gone", None, 1.0))
    got = sorted(str(r["Item"]) for r in cleaning.standardise_names(data, m).collect())
    assert got == ["Black Tea", "Filter", "Gone", "Latte Hot", "Mocha Ice", "Mocha Ice", "None"]


def test_suffix_prefers_hot(spark):
    m = menu(spark, "Tea Hot", "Tea Ice", "Soda Ice", "Plain", "plain hot", "Cola Ice Hot", "Cola Ice Ice")
    assert rows(cleaning.suffix_lookup(m), "base") == [
        ("cola ice", "Cola Ice Ice"), ("soda", "Soda Ice"), ("tea", "Tea Hot")]
    data = lines(spark, *[(D(2025, 1, 1), n, None, 1.0) for n in ("tea", "SODA", "plain", "none", None)])
    got = sorted(str(r["Item"]) for r in cleaning.suffix_match(data, m).collect())
    assert got == ["None", "Soda Ice", "Tea Hot", "none", "plain"]


def test_missing_items_are_never_discontinued(spark):
    m = menu(spark, "Latte")
    data = lines(spark, (D(2025, 1, 1), "latte", None, 1.0), (D(2025, 1, 2), None, None, 1.0),
                 (D(2025, 1, 3), "Gone", None, 2.0), (D(2025, 1, 5), "Gone", None, None), (D(2025, 1, 4), " ", None, 1.0))
    assert sorted(str(r["Item"]) for r in cleaning.keep_active(data, m).collect()) == [" ", "None", "latte"]
    assert cleaning.keep_active(data, m, remove=False).count() == 5
    assert rows(cleaning.discontinued_report(data, m)) == [("Gone", 2.0, 2, D(2025, 1, 3), D(2025, 1, 5))]


def test_cleaning_stats(spark):
    m = menu(spark, "Chocolate Hot")
    data = lines(spark, (D(2025, 1, 1), "coklat", None, 1.0), (D(2025, 1, 1), "Gone", None, 1.0),
                 (D(2025, 1, 1), "Gone", None, 1.0), (D(2025, 1, 1), "Lost", None, 1.0))
    assert rows(cleaning.cleaning_stats(data, m)) == [(4, 1, 2, 3)]


def test_packages_expand(spark):
    data = lines(spark, (D(2025, 1, 1), "Mie Goreng Telur", None, 2.0), (D(2025, 1, 1), "Tea", None, 1.0))
    got = rows(cleaning.expand_packages(data).select("Item", "Quantity"), "Item")
    assert got == [("Add Telur", 2.0), ("Mie Goreng", 2.0), ("Tea", 1.0)]
    for parts in cleaning.PACKAGES.values():
        assert all(len(p) == 2 for p in parts)


def test_item_filters(spark):
    data = lines(spark, *[(D(2025, 1, 1), n, None, 1.0) for n in (
        "Add Telur", " add keju", "Cheese Cake Slice", "ESPRESSO Bon-Bon", "Ladder")])
    kept = cleaning.exclude_items(cleaning.consolidate(data))
    assert sorted(r["Item"] for r in kept.collect()) == ["Ladder", "espresso"]


def test_snake_case_blanks(spark):
    data = spark.createDataFrame([("a", " ", "nan", "x", "2.5")],
                                 "Item string, SKU string, Variant string, Quantity string, `Net sales` string")
    got = cleaning.snake_case_sales(data).first().asDict()
    assert got == {"sku": None, "item": "a", "variant": None, "quantity": None, "net_sales": 2.5}


def test_daily_aggregates_agree(spark):
    cats = spark.createDataFrame([("A", "Food"), ("B", "Drink"), ("B", "Zed")], "Item string, Tipe string")
    data = spark.createDataFrame(
        [(dt.datetime(2025, 1, 4, 9), " A ", 2.0, 1.0, 1.5), (dt.datetime(2025, 1, 4, 19), "A", 1.0, 1.0, 1.5),
         (dt.datetime(2025, 1, 4, 9), "B", 1.0, 1.0, 1.5), (dt.datetime(2025, 1, 4, 9), "C", 4.0, 1.0, 1.5),
         (dt.datetime(2025, 1, 5, 9), "A", -3.0, 1.0, 1.5), (dt.datetime(2025, 1, 5, 9), "A", None, 1.0, 1.5)],
        "Date timestamp_ntz, Item string, Quantity double, `Net sales` double, `Gross sales` double")
    daily = aggregates.daily_item_sales(data, aggregates.last_category(cats))
    got = rows(daily.select("Item", "Category", "Quantity", "IsWeekend"), "Item")
    assert got == [("A", "Food", 3.0, 1), ("B", "Zed", 1.0, 1), ("C", "Unknown", 4.0, 1)]
    by_category, total = aggregates.daily_category_sales(daily), aggregates.daily_total_sales(daily)
    sums = [d.agg(F.sum("Quantity")).first()[0] for d in (daily, by_category, total)]
    assert sums == [8.0, 8.0, 8.0]
    assert total.select("UniqueItemCount", "UniqueCategoryCount").first() == (3, 3)
    for frame, key in ((daily, ["Date_Only", "Item"]), (by_category, ["Date_Only", "Category"]), (total, ["Date_Only"])):
        assert frame.groupBy(*key).count().where("count > 1").isEmpty()
    periods = aggregates.period_sales(data)
    assert rows(periods.groupBy("Time_Period").agg(F.sum("Quantity_Sold")), "Time_Period") == [
        ("08:00-13:00", 4.0), ("18:00-24:00", 1.0)]

"""Explicit schemas of the domain tables; readers never infer."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

_S, _D, _I, _L = StringType(), DoubleType(), IntegerType(), LongType()


def _table(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


# Canonical receipt columns, in order.
RECEIPT_COLUMNS = (
    "Date", "Receipt number", "Receipt type", "Category", "SKU", "Item", "Variant",
    "Modifiers applied", "Quantity", "Gross sales", "Discounts", "Net sales", "Cost of goods",
    "Gross profit", "Taxes", "Dining option", "POS", "Store", "Cashier name", "Customer name",
    "Customer contacts", "Comment", "Status",
)
RECEIPT_NUMBERS = (
    "Quantity", "Gross sales", "Discounts", "Net sales", "Cost of goods", "Gross profit", "Taxes",
)
# Receipt headers of the Indonesian export and their English names.
INDONESIAN_HEADERS = {
    "Tanggal": "Date",
    "Nomor struk": "Receipt number",
    "Jenis struk": "Receipt type",
    "Kategori": "Category",
    "SKU": "SKU",
    "Barang": "Item",
    "Varian": "Variant",
    "Pemodifikasi diterapkan": "Modifiers applied",
    "Kuantitas": "Quantity",
    "Penjualan Kotor": "Gross sales",
    "Diskon": "Discounts",
    "Penjualan bersih": "Net sales",
    "Harga pokok": "Cost of goods",
    "Laba kotor": "Gross profit",
    "Pajak": "Taxes",
    "Jenis pesanan": "Dining option",
    "POS": "POS",
    "Toko": "Store",
    "Nama Kasir": "Cashier name",
    "Nama Pelanggan": "Customer name",
    "Kontak Pelanggan": "Customer contacts",
    "Komentar": "Comment",
    "Keadaan": "Status",
}
# Cell values of that export.
INDONESIAN_VALUES = {
    "Receipt type": {"Penjualan": "Sale"},
    "Dining option": {"Makan di tempat": "Dine in"},
    "Status": {"Ditutup": "Closed"},
}

RECEIPTS = StructType([
    StructField(name, TimestampType() if name == "Date" else _D if name in RECEIPT_NUMBERS else _S)
    for name in RECEIPT_COLUMNS
])

# Columns that every daily table of the stage folder ends with.
_DATE_PARTS = [
    StructField("Year", _I), StructField("Month", _I), StructField("Day", _I),
    StructField("DayOfWeek", _I), StructField("DayOfWeekName", _S), StructField("WeekOfYear", _I),
    StructField("Quarter", _I), StructField("DayOfYear", _I), StructField("IsWeekend", _I),
    StructField("MonthProgress", _D),
]
_SUMS = [StructField("Quantity", _D), StructField("Net sales", _D), StructField("Gross sales", _D)]
DAILY_ITEM_SALES = StructType([
    StructField("Date_Only", DateType()), StructField("Item", _S), StructField("Category", _S), *_SUMS, *_DATE_PARTS])
DAILY_CATEGORY_SALES = StructType([
    StructField("Date_Only", DateType()), StructField("Category", _S), *_SUMS, StructField("UniqueItemCount", _L), *_DATE_PARTS])
DAILY_TOTAL_SALES = StructType([
    StructField("Date_Only", DateType()), *_SUMS, StructField("UniqueItemCount", _L), StructField("UniqueCategoryCount", _L),
    *_DATE_PARTS])
# Quantities stay text in the BOM files: a line whose quantity is not a number is skipped later.
MENU_BOM = _table(Tipe=_S, Item=_S, Bahan=_S, Qty=_S, Unit=_S)
CONDIMENT_BOM = _table(
    Condiment=_S, Condiment_Qty=_S, Condiment_Unit=_S, Sub_Ingredient=_S,
    Qty_per_condiment_unit=_S, Sub_Unit=_S,
)
FORECAST_FILE = _table(Date=DateType(), Item=_S, Quantity_Sold=_D)
MODEL_RUNS = _table(
    id=_I, model_type=_S, trained_at=TimestampType(), n_item_models=_I, n_records=_L,
    date_range_start=DateType(), date_range_end=DateType(), r2=_D, wmape=_D, mae=_D,
    volume_accuracy=_D, median_period_accuracy=_D, periods_within_20pct=_D,
    periods_within_50pct=_D, features=_S, items_with_models=_S, is_active=BooleanType(),
)
RUN_CLASS_METRICS = _table(
    model_run_id=_I, abc_class=_S, n_items=_L, wmape=_D, volume_accuracy=_D,
    median_period_accuracy=_D)
RUN_TOP_ITEMS = _table(
    model_run_id=_I, item_name=_S, quantity_sold=_D, predicted=_D, accuracy_pct=_D)
RUN_ITEM_MODELS = _table(model_run_id=_I, item_name=_S)
FORECASTS = _table(model_run_id=_I, item_id=_L, date=DateType(), quantity_predicted=_D)

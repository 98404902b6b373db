"""Small frames for the tests."""

import datetime as dt

D = dt.date


def rows(df, *order):
    """Rows as tuples, ordered."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def series_frame(spark, values: dict, start=D(2025, 1, 6), step=7):
    """Item, Date, Quantity_Sold from lists of quantities."""
    data = [
        (item, start + dt.timedelta(days=step * i), float(q))
        for item, quantities in values.items() for i, q in enumerate(quantities)
    ]
    return spark.createDataFrame(data, "Item string, Date date, Quantity_Sold double")

"""Day or month first? Told for each file from all of its dates.

A date such as ``15/01/2024`` admits one order, ``02/03/2024`` both. Each cell gives a mask of the orders
that it admits, and a file is read in the order that all of its cells admit. The masks are combined
within tasks; what is shuffled is one row for each file and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.operators.lookup import attach

MONTH_FIRST, DAY_FIRST = "month first", "day first"
#: Both orders fit all dates, and they give different days: the month is taken to be first.
AMBIGUOUS = "ambiguous"
#: Some dates admit one order only and some the other: the file has no readable order.
MIXED = "mixed"

_SLASHES = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
_MONTH, _DAY = 1, 2


def _read(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(F.when(text.rlike(_SLASHES), text), F.lit(pattern)).cast("date")


def date_orders(rows: DataFrame, file: Sequence[str] = ("file",), date: str = "date") -> DataFrame:
    """One row for each file: ``date_order`` (one of the names above, NULL where no date is written
    with slashes), ``slash_dates`` and ``open_dates``, those that both orders would read as
    different days. Cells in other spellings, empty ones and those that are no date say nothing."""
    cells = rows.select(
        *file,
        _read(F.col(date), "M/d/yyyy").alias("_month"),
        _read(F.col(date), "d/M/yyyy").alias("_day"),
    )
    month, day = F.col("_month").isNotNull(), F.col("_day").isNotNull()
    mask = F.when(month, _MONTH).otherwise(0) + F.when(day, _DAY).otherwise(0)
    found = cells.groupBy(*file).agg(
        F.bit_and(F.when(month | day, mask)).alias("_orders"),
        F.count_if(month | day).alias("slash_dates"),
        F.count_if(month & day & (F.col("_month") != F.col("_day"))).alias("open_dates"),
    )
    both = F.when(F.col("open_dates") > 0, AMBIGUOUS).otherwise(MONTH_FIRST)
    order = (
        F.when(F.col("_orders") == _MONTH, MONTH_FIRST)
        .when(F.col("_orders") == _DAY, DAY_FIRST)
        .when(F.col("_orders") == _MONTH + _DAY, both)
        .when(F.col("_orders") == 0, MIXED)
    )
    return found.select(*file, order.alias("date_order"), "slash_dates", "open_dates")


def with_month_first(rows: DataFrame, orders: DataFrame, date: str = "date") -> DataFrame:
    """The rows with the dates of day-first files written year first, so that all later steps read
    them alike. ``orders`` has a row for each ``file``; rows of one large file stay spread."""
    day_first = orders.filter(F.col("date_order") == DAY_FIRST).select("file", F.lit(True).alias("_day_first"))
    read = _read(F.col(date), "d/M/yyyy").cast("string")
    turned = F.when(F.col("_day_first"), F.coalesce(read, F.col(date))).otherwise(F.col(date))
    return attach(rows, day_first, ["file"]).withColumn(date, turned).drop("_day_first")

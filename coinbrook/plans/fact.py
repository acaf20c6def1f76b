"""The fact table: raw rows with constants, renamed columns and calendar columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.dates import calendar_columns
from coinbrook.operators.lookup import absent_from
from coinbrook.schemas import CURRENCY, FCT_EXPENSE


def build_fact(expenses: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """All rows of the raw table as fact rows. ``as_of`` stamps the two clock columns (default: now)."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    nothing = F.expr("CAST(NULL AS STRING)")
    columns = {
        "id": "id",
        "expense_date": "date",
        "booked_date": now.cast("date"),
        "last_modified_at": now,
        "description": "description",
        "parent_category": "category",
        "sub_category": nothing,
        "category_tag": nothing,
        "expend_amount": "amount",
        "currency": F.lit(CURRENCY),
        "from_account_marker": "from_account",
        "towards_category": "towards",
        "towards_sub_category": nothing,
        "towards_category_tag": nothing,
        **calendar_columns("date"),
    }
    return expenses.select(
        *[
            (F.col(source) if isinstance(source, str) else source).alias(name)
            for name, source in columns.items()
        ]
    )


def new_facts(
    expenses: DataFrame,
    fact: DataFrame,
    as_of: dt.datetime | None = None,
    small_batch: bool = True,
) -> DataFrame:
    """Fact rows for the raw rows the fact table lacks.

    A fact row depends on its raw row alone, so adding these equals a rebuild. The comparison is
    by id and year: with a fact table partitioned by year, only the years of the batch are read.
    With ``small_batch`` the fact table is first cut down to the ids of the batch; where the raw
    rows are of the size of the table itself, one join is the shorter way.
    """
    key = ["id", "_year"]
    lines = expenses.withColumn("_year", F.expr("coalesce(year(date), 0)"))
    known = fact.select("id", F.expr("coalesce(year, 0)").alias("_year"))
    if small_batch:
        fresh = absent_from(lines, known, key)
    else:
        fresh = lines.join(known, key, "left_anti")
    return build_fact(fresh, as_of)

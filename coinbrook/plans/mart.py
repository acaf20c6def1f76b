"""All grouped KPIs from a single read of the fact table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.amounts import money_parts, money_total, nan_to_null
from coinbrook.plans.kpis import AMOUNT, headline, highest_expenses

# KPI name -> its group keys.
KPI_KEYS = {
    "category": ["parent_category"],
    "monthly": ["year", "month", "month_year_marker"],
    "weekday": ["num_day_of_week", "day_of_week"],
    "season": ["season"],
    "account": ["from_account_marker"],
    "tag": ["category_tag"],
    "towards": ["towards_category"],
}


def kpi_mart(fact: DataFrame) -> DataFrame:
    """Total, mean and number of expenses for every group of every grouped KPI.

    One scan and one shuffle of partial sums serve all KPIs; ``kpi`` names the one a row belongs
    to, and only the key columns of that KPI are filled. Groups with a missing key are left out.
    """
    keys = [key for group in KPI_KEYS.values() for key in group]
    amount = F.col(AMOUNT)
    # Converted here, once per row: below, each row is handled once per KPI.
    parts = fact.select(
        *keys,
        *[part.alias(f"_part{i}") for i, part in enumerate(money_parts(amount))],
        nan_to_null(amount).isNotNull().alias("_present"),
    )
    total = money_total(*[F.sum(f"_part{i}") for i in range(3)])
    present = F.count_if("_present")
    cells = parts.groupingSets([[F.col(k) for k in g] for g in KPI_KEYS.values()], *keys).agg(
        total.alias("total"),
        F.when(present > 0, total / present).alias("mean"),
        F.count("*").alias("transactions"),
        *[F.grouping(key).alias(f"_{key}") for key in keys],
    )

    def belongs(group: list[str]) -> Column:
        filled = [(F.col(f"_{key}") == 0) & F.col(key).isNotNull() for key in group]
        return reduce(Column.__and__, filled)

    kpi = F.coalesce(*[F.when(belongs(group), F.lit(name)) for name, group in KPI_KEYS.items()])
    return (
        cells.withColumn("kpi", kpi)
        .filter(F.col("kpi").isNotNull())
        .select("kpi", *keys, "total", "mean", "transactions")
    )


def stored_mart(fact: DataFrame, n: int = 10) -> DataFrame:
    """The grouped KPIs, the headline (its top category as ``parent_category``) and the ``n``
    highest expenses (their amounts as ``total``) as rows of one table."""
    top = highest_expenses(fact, n).withColumnRenamed(AMOUNT, "total")
    first = headline(fact).select(
        F.col("total_expenses").alias("total"),
        F.col("total_transactions").alias("transactions"),
        F.col("top_category").alias("parent_category"),
    )
    rows = kpi_mart(fact)
    for name, frame in (("headline", first), ("top", top)):
        rows = rows.unionByName(frame.withColumn("kpi", F.lit(name)), allowMissingColumns=True)
    return rows


def read_kpi(mart: DataFrame, kpi: str) -> DataFrame:
    """One KPI from the mart: its key columns and measures."""
    columns = {
        "headline": ["total", "transactions", "parent_category"],
        "top": ["expense_date", "description", "parent_category", "total"],
        "daily": ["expense_date", "total", "transactions"],
        "balances": ["name", "type", "current_balance", "currency"],
    }.get(kpi) or [*KPI_KEYS[kpi], "total", "mean", "transactions"]
    return mart.filter(F.col("kpi") == kpi).select(*columns)

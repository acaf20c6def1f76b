"""The spending KPIs, each a lazy frame over the fact or account table.

Sorted results break ties by key, so a KPI gives the same rows in the same order on every run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.amounts import money_parts, money_total, nan_to_null
from coinbrook.operators.grouping import mean_by, sum_by
from coinbrook.operators.running_total import ROWS_PER_SPLIT, running_total

AMOUNT = "expend_amount"

# The spellings of ``functions.dates.DATE_FORMATS`` for filters; as there, the month comes first.
_MOMENTS = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%Y%m%d",
    "%d %b %Y",
    "%b %d, %Y",
)


def filter_expenses(
    fact: DataFrame,
    filter_category: Sequence[str] | None = None,
    filter_start_date: str | dt.date | None = None,
    filter_end_date: str | dt.date | None = None,
) -> DataFrame:
    """Optional filters; an empty one does not filter. Both date bounds are inclusive.

    A start with a time of day leaves its own date out. The bounds become plain date
    comparisons plus the matching years, which reach the scan as pushed and partition filters.
    """
    if filter_category:
        fact = fact.filter(F.col("parent_category").isin(list(filter_category)))
    if filter_start_date:
        start = _moment(filter_start_date)
        first = start.date()
        if start.time() > dt.time.min:
            first += dt.timedelta(days=1)
        fact = fact.filter((F.col("expense_date") >= F.lit(first)) & _year(fact, ">=", first))
    if filter_end_date:
        last = _moment(filter_end_date).date()
        fact = fact.filter((F.col("expense_date") <= F.lit(last)) & _year(fact, "<=", last))
    return fact


def _moment(value: str | dt.date) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time.min)
    text = value.strip()
    for spelling in _MOMENTS:
        try:
            return dt.datetime.strptime(text, spelling)
        except ValueError:
            continue
    return dt.datetime.fromisoformat(text)


def _year(fact: DataFrame, comparison: str, date: dt.date) -> Column:
    if "year" not in fact.columns:
        return F.lit(True)
    return F.col("year") >= date.year if comparison == ">=" else F.col("year") <= date.year


def _largest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(AMOUNT).desc_nulls_last(), F.col(key).asc())


def total_per_category(
    fact: DataFrame,
    filter_category: Sequence[str] | None = None,
    filter_start_date: str | dt.date | None = None,
    filter_end_date: str | dt.date | None = None,
) -> DataFrame:
    """KPI 1: total per category, largest first."""
    rows = filter_expenses(fact, filter_category, filter_start_date, filter_end_date)
    return _largest_first(sum_by(rows, ["parent_category"], AMOUNT), "parent_category")


def monthly_trend(fact: DataFrame) -> DataFrame:
    """KPI 2: total per month, in time order; months without expenses have no row."""
    return sum_by(fact, ["year", "month", "month_year_marker"], AMOUNT).orderBy("year", "month")


def weekday_average(fact: DataFrame) -> DataFrame:
    """KPI 3: mean expense per weekday, Sunday first."""
    return mean_by(fact, ["num_day_of_week", "day_of_week"], AMOUNT).orderBy("num_day_of_week")


def highest_expenses(fact: DataFrame, n: int = 10) -> DataFrame:
    """KPI 4: the n single largest expenses; equal amounts by lowest id."""
    amount = nan_to_null(F.col(AMOUNT))
    return (
        fact.orderBy(amount.desc_nulls_last(), F.col("id").asc_nulls_last())
        .limit(n)
        .select("expense_date", "description", "parent_category", AMOUNT)
    )


def seasonal_breakdown(fact: DataFrame) -> DataFrame:
    """KPI 5: total per season over all years, largest first."""
    return _largest_first(sum_by(fact, ["season"], AMOUNT), "season")


def account_summary(fact: DataFrame) -> DataFrame:
    """KPI 6: total per paying account, largest first."""
    return _largest_first(sum_by(fact, ["from_account_marker"], AMOUNT), "from_account_marker")


def category_tag_insights(fact: DataFrame) -> DataFrame:
    """KPI 7: total per category tag, largest first; empty where nothing is tagged."""
    return _largest_first(sum_by(fact, ["category_tag"], AMOUNT), "category_tag")


def towards_analysis(fact: DataFrame) -> DataFrame:
    """KPI 8: total per destination, largest first."""
    return _largest_first(sum_by(fact, ["towards_category"], AMOUNT), "towards_category")


def account_balances(accounts: DataFrame) -> DataFrame:
    """KPI 9: balance per account, highest first. Currencies are not converted."""
    return accounts.select("name", "type", "current_balance", "currency").orderBy(
        nan_to_null(F.col("current_balance")).desc_nulls_last(), "name", "type", "currency"
    )


def cumulative_trend(fact: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """KPI 10: running total by date, one row per expense, in date order."""
    rows = fact.select("expense_date", "id", AMOUNT)
    total = running_total(rows, "expense_date", "id", AMOUNT, "cumulative_amount", rows_per_split)
    return total.select("expense_date", "cumulative_amount")


def headline(fact: DataFrame) -> DataFrame:
    """Total, number of expenses and top category in one row; no row for an empty ledger.

    One pass: the table is first summed per category, and all three come from those sums.
    Equal category totals go to the first name.
    """
    parts = ["high", "low", "beyond"]
    sums = [F.sum(p).alias(n) for p, n in zip(money_parts(F.col(AMOUNT)), parts)]
    per_category = (
        fact.groupBy("parent_category")
        .agg(*sums, F.count("*").alias("rows"))
        .withColumn("total", money_total(*[F.col(n) for n in parts]))
    )
    named = F.when(
        F.col("parent_category").isNotNull(),
        F.struct((-F.col("total")).alias("order"), F.col("parent_category").alias("name")),
    )
    return per_category.agg(
        money_total(*[F.sum(n) for n in parts]).alias("total_expenses"),
        F.sum("rows").alias("total_transactions"),
        F.min(named)["name"].alias("top_category"),
    ).filter("total_transactions > 0")

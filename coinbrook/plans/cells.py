"""A KPI mart that imports keep up to date: partial sums by batch, merged when they are read.

A cell holds the sums of one group of one KPI in one year of one batch: the three parts of a money
sum, the amounts present and the rows. Cells of different batches are added up, so a batch brings its
own cells and no other row is read. The same goes for the highest expenses of a year, and for the
totals of days that the running total starts from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.functions.amounts import money_parts, money_total, nan_to_null
from coinbrook.operators.running_total import ROWS_PER_SPLIT, starts_of_days
from coinbrook.plans.kpis import AMOUNT, account_balances
from coinbrook.plans.mart import KPI_KEYS

#: Highest expenses kept of each year and batch.
TOP = 10

_KEYS = [key for group in KPI_KEYS.values() for key in group if key != "year"]
#: KPI name -> its group keys besides the year: the grouped KPIs, all expenses, and the days.
CELL_KEYS = {name: [k for k in group if k != "year"] for name, group in KPI_KEYS.items()}
CELL_KEYS |= {"all": [], "day": ["expense_date"]}
CELL_COLUMNS = [*_KEYS, "expense_date"]
SUMS = ["high", "low", "beyond", "present", "rows"]
TOP_COLUMNS = ["year", "id", "expense_date", "description", "parent_category", AMOUNT]


def mart_cells(fact: DataFrame) -> DataFrame:
    """The cells of some facts: one scan, and one shuffle of partial sums. ``kpi`` names the KPI;
    only its key columns are filled. Groups with a missing key are left out, as in the KPIs; facts
    without a date have a year and a day of their own, NULL."""
    amount = F.col(AMOUNT)
    parts = fact.select(
        "year",
        *CELL_COLUMNS,
        *[part.alias(name) for name, part in zip(SUMS, money_parts(amount))],
        nan_to_null(amount).isNotNull().alias("present"),
    )
    sets = [["year", *keys] for keys in CELL_KEYS.values()]
    cells = parts.groupingSets([[F.col(k) for k in s] for s in sets], "year", *CELL_COLUMNS).agg(
        *[F.sum(name).alias(name) for name in SUMS[:3]],
        F.count_if("present").alias("present"),
        F.count("*").alias("rows"),
        *[F.grouping(key).alias(f"_{key}") for key in CELL_COLUMNS],
    )

    def belongs(name: str, keys: Sequence[str]) -> Column:
        own = [F.col(f"_{key}") == (0 if key in keys else 1) for key in CELL_COLUMNS]
        filled = [F.col(key).isNotNull() for key in keys if name != "day"]
        if name == "monthly":
            filled.append(F.col("year").isNotNull())
        return reduce(Column.__and__, own + filled)

    kpi = F.coalesce(*[F.when(belongs(name, keys), F.lit(name)) for name, keys in CELL_KEYS.items()])
    return cells.withColumn("kpi", kpi).filter("kpi is not null").select("kpi", "year", *CELL_COLUMNS, *SUMS)


def top_of_years(fact: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` highest expenses of each year, equal amounts by lowest id; merging is doing it again
    on the union."""
    order = [nan_to_null(F.col(AMOUNT)).desc_nulls_last(), F.col("id").asc_nulls_last()]
    place = F.row_number().over(Window.partitionBy("year").orderBy(*order))
    return fact.select(*TOP_COLUMNS).withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells of several batches as if of one."""
    sums = [F.sum(name).alias(name) for name in SUMS]
    return cells.groupBy("kpi", "year", *CELL_COLUMNS).agg(*sums)


def _total() -> Column:
    return money_total(*[F.col(name) for name in SUMS[:3]])


def _of_all_years(cells: DataFrame) -> DataFrame:
    """Sums over the years; the monthly KPI keeps its own."""
    year = F.when(F.col("kpi") == "monthly", F.col("year")).alias("year")
    return cells.groupBy("kpi", year, *CELL_COLUMNS).agg(*[F.sum(name).alias(name) for name in SUMS])


def grouped_kpis(cells: DataFrame) -> DataFrame:
    """The rows of ``plans.mart.kpi_mart`` from cells."""
    keys = [key for group in KPI_KEYS.values() for key in group]
    sums = _of_all_years(cells.filter(F.col("kpi").isin(list(KPI_KEYS))))
    mean = F.when(F.col("present") > 0, _total() / F.col("present"))
    return sums.select("kpi", *keys, _total().alias("total"), mean.alias("mean"), F.col("rows").alias("transactions"))


def headline_kpi(cells: DataFrame) -> DataFrame:
    """``plans.kpis.headline`` from cells, in the columns of the mart."""
    own = _of_all_years(cells.filter(F.col("kpi").isin("all", "category"))).withColumn("total", _total())
    whole = F.col("kpi") == "all"
    first = F.min(F.when(~whole, F.struct((-F.col("total")).alias("order"), F.col("parent_category").alias("name"))))
    return own.agg(
        F.max(F.when(whole, F.col("total"))).alias("total"),
        F.max(F.when(whole, F.col("rows"))).alias("transactions"),
        first["name"].alias("parent_category"),
    ).filter("transactions > 0")


def daily_kpi(cells: DataFrame) -> DataFrame:
    """What was spent up to and with each day: the running total at the ends of the days."""
    days = _of_all_years(cells.filter("kpi = 'day'"))
    # One row a day, 3.7 million at most, however many facts there are.
    so_far = Window.orderBy(F.col("expense_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = money_total(*[F.sum(name).over(so_far) for name in SUMS[:3]])
    return days.select("expense_date", total.alias("total"), F.col("rows").alias("transactions"))


def mart_of(cells: DataFrame, top: DataFrame, accounts: DataFrame | None = None, n: int = TOP) -> DataFrame:
    """All KPIs as the rows of one table, for ``plans.mart.read_kpi``: the grouped ones, the headline,
    the ``n`` highest expenses, the running total by day, and with ``accounts`` the balances."""
    order = [nan_to_null(F.col(AMOUNT)).desc_nulls_last(), F.col("id").asc_nulls_last()]
    highest = top.orderBy(*order).limit(n).select(
        "expense_date", "description", "parent_category", F.col(AMOUNT).alias("total")
    )
    rows = grouped_kpis(cells)
    more = {"headline": headline_kpi(cells), "top": highest, "daily": daily_kpi(cells)}
    if accounts is not None:
        more["balances"] = account_balances(accounts)
    for name, frame in more.items():
        rows = rows.unionByName(frame.withColumn("kpi", F.lit(name)), allowMissingColumns=True)
    return rows


def busy_days(cells: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Days of more rows than one task should sort: ``day``, ``day_rows`` and ``splits``."""
    days = cells.filter("kpi = 'day'").groupBy(F.col("expense_date").alias("day")).agg(F.sum("rows").alias("day_rows"))
    splits = F.ceil(F.col("day_rows") / F.lit(rows_per_split)).cast("int")
    return days.filter(F.col("day_rows") > rows_per_split).withColumn("splits", splits)


def running_starts(cells: DataFrame, splits: DataFrame) -> DataFrame:
    """Totals before each day and split, for ``running_total``, from cells and the stored sums of
    the splits of busy days, of which those with the most rows of their day count. A batch with
    early dates changes what is before later days; their rows are not read."""
    units = F.col("high").cast("decimal(30,0)") * F.lit(2**20) + F.col("low")
    days = _of_all_years(cells.filter("kpi = 'day'")).select(
        F.col("expense_date").alias("_day"), units.cast("decimal(38,0)").alias("units"), "beyond"
    )
    newest = Window.partitionBy("day")
    current = splits.withColumn("_most", F.max("day_rows").over(newest)).filter("day_rows = _most")
    return starts_of_days(
        days.join(
            current.select(F.col("day").alias("_busy"), "splits").distinct(),
            F.col("_day").eqNullSafe(F.col("_busy")),
            "left",
        ).withColumn("_splits", F.coalesce("splits", F.lit(1))).select("_day", "_splits", "units", "beyond"),
        current.select(F.col("day").alias("_day"), F.col("split").alias("_split"), "units", "beyond"),
    )

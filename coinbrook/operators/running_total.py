"""Running total over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.functions.amounts import beyond_units, join_units, nan_to_null, units

ROWS_PER_SPLIT = 4_000_000
MAX_SPLITS = 100_000
_HASH_RANGE = 2**32


def running_total(
    df: DataFrame,
    date: str,
    id_col: str,
    amount: str,
    out: str,
    rows_per_split: int = ROWS_PER_SPLIT,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``, the sum of all amounts up to and with the row, in date order.

    Rows without a date come last. Rows of one day are ordered by the md5 of their id (of the amount
    where there is no id), which lets a busy day be cut into even, ordered splits. Three steps:

    1. one sum and count per day, and from them what was spent before the day;
    2. for days above ``rows_per_split`` rows only, the same per split of the day;
    3. a window inside each (day, split), lifted by the total before it.

    The rows are shuffled once, by range of (day, split); this also leaves them sorted. A row
    without an amount gets NULL and does not interrupt the sum.

    ``starts`` are stored totals as ``starts_of_days`` gives them; with these, steps 1 and 2 fall
    away, and ``df`` may be some days of the table only.
    """
    keyed = _keyed(df, id_col, amount)
    before = F.broadcast(_totals_before(keyed, date, rows_per_split) if starts is None else starts)
    placed = (
        keyed.join(before, F.col(date).eqNullSafe(F.col("_day")), "left")
        .withColumn("_split", _split_of("_tie", F.size("_before")))
        .withColumn("_start", F.element_at("_before", F.col("_split") + 1))
        .repartitionByRange(F.col(date).asc_nulls_last(), F.col("_split"))
    )
    window = (
        Window.partitionBy(date, "_split")
        .orderBy("_tie", id_col, amount)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = F.col("_start.units") + F.coalesce(F.sum("_units").over(window), F.lit(0))
    beyond = F.col("_start.beyond") + F.coalesce(F.sum("_beyond").over(window), F.lit(0.0))
    present = nan_to_null(F.col(amount)).isNotNull()
    return (
        placed.withColumn(out, F.when(present, join_units(whole.cast("decimal(31,0)"), beyond)))
        .sortWithinPartitions(F.col(date).asc_nulls_last(), "_split", "_tie", id_col, amount)
        .drop("_units", "_beyond", "_tie", "_day", "_before", "_split", "_start")
    )


def _keyed(df: DataFrame, id_col: str, amount: str) -> DataFrame:
    # Rows without an id are spread by their amount.
    tie = F.coalesce(F.col(id_col).cast("string"), F.col(amount).cast("string"), F.lit(""))
    return df.withColumns(
        {
            "_units": units(F.col(amount)).cast("decimal(18,0)"),
            "_beyond": beyond_units(F.col(amount)),
            "_tie": F.md5(tie.cast("binary")),
        }
    )


def sums_of_splits(df: DataFrame, date: str, id_col: str, amount: str, busy: DataFrame) -> DataFrame:
    """``units`` and ``beyond`` of each split of the busy days (``_day``, ``_splits``)."""
    return _sums_of_splits(_keyed(df, id_col, amount), date, busy)


def _split_of(tie: str, splits: Column) -> Column:
    """Split number of a row; a larger md5 never gives a smaller number."""
    prefix = F.conv(F.substring(tie, 1, 8), 16, 10).cast("bigint")
    return F.floor(prefix * splits / F.lit(_HASH_RANGE)).cast("int")


def _totals_before(keyed: DataFrame, date: str, rows_per_split: int) -> DataFrame:
    """One row per day: ``_before`` holds the totals before each split of the day.

    There are at most 3.7 million days in the calendar and about ``MAX_SPLITS`` splits beyond
    one per day, however many rows the table has: small enough for one sort and a broadcast.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = keyed.groupBy(F.col(date).alias("_day")).agg(F.count("*").alias("_rows"), *_part_sums())
    limit = F.greatest(F.lit(rows_per_split), F.ceil(F.sum("_rows").over(whole) / MAX_SPLITS))
    days = days.withColumn("_splits", F.ceil(F.col("_rows") / limit).cast("int")).drop("_rows")
    busy = days.filter("_splits > 1").select("_day", "_splits")
    return starts_of_days(days, _sums_of_splits(keyed, date, busy))


def _sums_of_splits(keyed: DataFrame, date: str, busy: DataFrame) -> DataFrame:
    return (
        keyed.join(F.broadcast(busy), F.col(date).eqNullSafe(F.col("_day")))
        .withColumn("_split", _split_of("_tie", F.col("_splits")))
        .groupBy("_day", "_split")
        .agg(*_part_sums())
    )


def starts_of_days(sums: DataFrame, splits: DataFrame) -> DataFrame:
    """``_day`` and ``_before``, the totals before each of its splits, from the sums of the days
    (``_day``, ``_splits``, ``units``, ``beyond``) and of the splits (``_split``) of those that have
    several. One sort of a row for each day."""
    by_day = Window.orderBy(F.col("_day").asc_nulls_last())
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    days = sums.select(
        "_day",
        "_splits",
        F.struct(
            F.coalesce(F.sum("units").over(earlier), F.lit(0)).cast("decimal(31,0)").alias("units"),
            F.coalesce(F.sum("beyond").over(earlier), F.lit(0.0)).alias("beyond"),
        ).alias("_start"),
    )
    busy = days.filter("_splits > 1")
    earlier_splits = (
        Window.partitionBy("_day").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    )
    # A split no row fell into still needs its place in the list.
    grid = busy.select(
        "_day", "_start", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)).alias("_split")
    )
    totals = (
        grid.alias("g")
        .join(
            splits.alias("s"),
            F.col("g._day").eqNullSafe(F.col("s._day")) & (F.col("g._split") == F.col("s._split")),
            "left",
        )
        .select("g._day", "g._split", "g._start", "s.units", "s.beyond")
        .select(
            "_day",
            "_split",
            F.struct(
                (F.col("_start.units") + F.coalesce(F.sum("units").over(earlier_splits), F.lit(0)))
                .cast("decimal(31,0)")
                .alias("units"),
                (
                    F.col("_start.beyond")
                    + F.coalesce(F.sum("beyond").over(earlier_splits), F.lit(0.0))
                ).alias("beyond"),
            ).alias("_start"),
        )
        .groupBy("_day")
        .agg(F.array_sort(F.collect_list(F.struct("_split", "_start"))).alias("_list"))
        .select("_day", F.col("_list._start").alias("_before"))
    )
    quiet = days.filter("_splits = 1").select("_day", F.array("_start").alias("_before"))
    return quiet.unionByName(totals)


def _part_sums() -> list[Column]:
    return [F.sum("_units").alias("units"), F.sum("_beyond").alias("beyond")]

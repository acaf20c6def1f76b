"""Dates: from text, and the calendar columns of the fact table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = "yyyy-M-d"
ISO_TIME = "yyyy-M-d[ HH:mm[:ss[.SSSSSS]]]['T'HH:mm[:ss[.SSSSSS]]]"

# The date spellings files may use, in the order they are tried. Where day and
# month could be swapped, the month comes first.
DATE_FORMATS = (
    ISO_DATE,
    ISO_TIME,
    "yyyy/M/d",
    "M/d/yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
)

# What a text of each format looks like. Only texts of that look are parsed by the format, since
# a failed parse costs far more than a match. A format that is not listed is tried on every text.
_SHAPES = {
    ISO_DATE: r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z",
    ISO_TIME: r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{2}:[0-9]{2}[0-9:.]*\z",
    "yyyy/M/d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z",
    "M/d/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z",
    "yyyyMMdd": r"^[0-9]{8}\z",
    "d MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}\z",
    "MMM d, yyyy": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}\z",
}


def parse_date(text: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Text to date by the first format that fits; NULL where none does."""
    text = text.cast("string")
    return F.coalesce(*[_parse_one(text, f) for f in formats])


def _parse_one(text: Column, pattern: str) -> Column:
    # The plain cast reads year-month-day as the pattern would, several times faster.
    if pattern == ISO_DATE:
        parsed = text.try_cast("date")
    else:
        parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    if pattern not in _SHAPES:
        return parsed
    return F.when(text.rlike(_SHAPES[pattern]), parsed)


def parse_iso_date(text: Column) -> Column:
    """Year-month-day only; empty, wrong or trailing text gives NULL."""
    return parse_date(text, [ISO_DATE])


# Names in the calendar columns.
_MONTHS = "array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec')"
_WEEKDAYS = "array('Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday')"


def season(date: str) -> Column:
    """Season by month of a date expression; a missing date falls to the last branch."""
    return F.expr(
        f"CASE WHEN month({date}) IN (12, 1, 2) THEN 'Winter' "
        f"WHEN month({date}) IN (3, 4, 5) THEN 'Spring' "
        f"WHEN month({date}) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"
    )


def calendar_columns(date: str) -> dict[str, Column]:
    """Calendar columns of a date expression, by name. The week starts with Sunday as day 0.

    Names are looked up by number, which costs less per row than formatting the date. The lookup
    is guarded since compiled element_at takes a missing number for -1.
    """
    columns = {
        "day_of_month": f"day({date})",
        "month": f"month({date})",
        "year": f"year({date})",
        "month_year": f"year({date}) * 100 + month({date})",
        "month_year_marker": f"IF({date} IS NOT NULL, concat(element_at({_MONTHS}, "
        f"month({date})), '-', lpad(CAST(year({date}) % 100 AS STRING), 2, '0')), NULL)",
        "num_day_of_week": f"dayofweek({date}) - 1",
        "day_of_week": f"IF({date} IS NOT NULL, "
        f"element_at({_WEEKDAYS}, dayofweek({date})), NULL)",
    }
    return {**{name: F.expr(sql) for name, sql in columns.items()}, "season": season(date)}

"""From raw input columns to the columns of the raw table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coinbrook.functions.amounts import coerce_amount, nan_to_null
from coinbrook.functions.dates import DATE_FORMATS, parse_date
from coinbrook.schemas import DEFAULT_CATEGORY, EXPENSES_LINE, FORM_LABELS


def column_name(label: str) -> str:
    """Lower case, blanks to underscores."""
    return label.lower().replace(" ", "_")


def normalize_header(df: DataFrame) -> DataFrame:
    """Normalise all column names; ``to_account`` stands in for a missing ``towards``."""
    df = df.toDF(*[column_name(c) for c in df.columns])
    if "towards" in df.columns:
        return df.drop("to_account")
    return df.withColumnRenamed("to_account", "towards")


def rename_form_labels(df: DataFrame) -> DataFrame:
    """Entry-form labels to column names; other columns pass."""
    return df.withColumnsRenamed(FORM_LABELS)


def default_category(df: DataFrame) -> DataFrame:
    """Add the default category where the column is absent; empty cells stay empty."""
    if "category" in df.columns:
        return df
    return df.withColumn("category", F.lit(DEFAULT_CATEGORY))


def with_id(df: DataFrame) -> DataFrame:
    """Add a random id per row where the column is absent. Write the result before using it
    twice: a second run of the plan draws other ids."""
    if "id" in df.columns:
        return df
    return df.withColumn("id", F.expr("uuid()"))


def to_expenses_line(
    df: DataFrame, formats: Iterable[str] = DATE_FORMATS, keep: Sequence[str] = ()
) -> DataFrame:
    """Raw rows, in any of the accepted namings, to the seven columns of the raw table.

    ``keep`` names further columns that pass unchanged. A bad amount becomes 0.0; a date text that
    no format fits fails the job, and with it the whole batch.
    """
    df = with_id(default_category(normalize_header(rename_form_labels(df))))
    typed = df.withColumns({"amount": _amount(df), "date": _date(df, formats)})
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in EXPENSES_LINE], *keep)


def _amount(df: DataFrame) -> Column:
    amount = F.col("amount")
    if isinstance(df.schema["amount"].dataType, T.NumericType):
        return F.coalesce(nan_to_null(amount.cast("double")), F.lit(0.0))
    return coerce_amount(amount)


def _date(df: DataFrame, formats: Iterable[str]) -> Column:
    if isinstance(df.schema["date"].dataType, T.DatetimeType):
        return F.col("date").cast("date")
    raw = F.col("date").cast("string")
    date = parse_date(raw, formats)
    bad = F.raise_error(F.concat(F.lit("not a date: "), raw)).cast("date")
    return F.when(date.isNull() & raw.isNotNull(), bad).otherwise(date)

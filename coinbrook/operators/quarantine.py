"""Rows of rejected files, each with what is wrong with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.amounts import is_finite, parse_amount
from coinbrook.functions.dates import parse_date
from coinbrook.functions.text import has_prohibited_symbol
from coinbrook.operators.duplicates import FILE_KEY, duplicate_groups, file_key
from coinbrook.operators.lookup import attach
from coinbrook.operators.validation import BAD_SYMBOLS, NOT_A_DATE, NOT_A_NUMBER, NOT_POSITIVE
from coinbrook.schemas import REQUIRED_FILE_COLUMNS

# Texts of the reports, beside those of ``operators.validation``.
MISSING_VALUE = "Missing value"
OVERLONG = "More fields than the header"
REPEATED = "Row occurs more than once in the file"
FILE_REJECTED = "File rejected"

#: Name of the columns that ``quarantined`` adds.
ERROR_COLUMNS = ["error_field", "error_reason", "error_value"]


def _error(field: str | None, reason: str, value: Column | None) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        (empty if field is None else F.lit(field)).alias("error_field"),
        F.lit(reason).alias("error_reason"),
        (empty if value is None else value.cast("string")).alias("error_value"),
    )


def _checks(rows: DataFrame, strict: bool) -> list[tuple[Column, Column]]:
    """Conditions and errors of a row by itself, in the order in which the file checks run."""
    have = [c for c in REQUIRED_FILE_COLUMNS if c in rows.columns]
    checks = [(F.col(c).isNull(), _error(c, MISSING_VALUE, None)) for c in have]
    number = parse_amount(F.col("amount")) if "amount" in have else None
    if number is not None:
        checks.append((number.isNull(), _error("amount", NOT_A_NUMBER, F.col("amount"))))
    if strict and "description" in have:
        bad = has_prohibited_symbol(F.col("description"))
        checks.append((bad, _error("description", BAD_SYMBOLS, F.col("description"))))
    if strict and number is not None:
        bad = ~is_finite(number) | (number <= 0)
        checks.append((bad, _error("amount", NOT_POSITIVE, F.col("amount"))))
    if "extra_fields" in rows.columns:
        extra = F.col("extra_fields")
        checks.append((extra.isNotNull(), _error(None, OVERLONG, extra)))
    repeated = F.col("_copies") > 1
    checks.append((F.coalesce(repeated, F.lit(False)), _error(None, REPEATED, F.col("_copies"))))
    if "date" in have:
        checks.append((parse_date(F.col("date")).isNull(), _error("date", NOT_A_DATE, F.col("date"))))
    return checks


def quarantined(rows: DataFrame, verdicts: DataFrame, accepted: str, strict: bool = False) -> DataFrame:
    """The rows of the files that are not accepted, with ``status``, ``error_field``, ``error_reason``
    and ``error_value``.

    ``rows`` have their ``file``; ``verdicts`` have ``file``, ``status`` and ``imported_as``, the name
    that blocks the file. A row reports the first check it fails. A sound row in a rejected file
    reports the verdict of the file, with the blocking name as value.

    Rows of one file, or copies of one row, are spread over tasks; what is joined to them has a row
    for each file or each group of copies.
    """
    rejected = verdicts.filter(F.col("status") != accepted).select(
        "file", "status", F.col("imported_as").cast("string").alias("_blocking")
    )
    own = attach(rows, rejected, ["file"]).filter("status is not null")
    if all(c in rows.columns for c in FILE_KEY):
        keyed = own.withColumns({f"_{c}": column for c, column in file_key(own.columns).items()})
        copies = duplicate_groups(own, ["file"]).select(
            "file", *[F.col(c).alias(f"_{c}") for c in FILE_KEY], F.col("occurrence_count").alias("_copies")
        )
        marked = attach(keyed, copies, ["file", *[f"_{c}" for c in FILE_KEY]]).drop(*[f"_{c}" for c in FILE_KEY])
    else:
        marked = own.withColumn("_copies", F.lit(None).cast("long"))
    checks = _checks(marked, strict)
    if {"id", "has_id"} <= set(rows.columns):
        checks.append((F.col("has_id") & F.col("id").isNull(), _error("id", MISSING_VALUE, None)))
    of_file = F.struct(
        F.lit(None).cast("string").alias("error_field"),
        F.concat_ws(": ", F.lit(FILE_REJECTED), F.col("status")).alias("error_reason"),
        F.col("_blocking").alias("error_value"),
    )
    (first, error), *others = checks
    found = reduce(lambda so_far, check: so_far.when(*check), others, F.when(first, error)).otherwise(of_file)
    judged = marked.withColumn("_error", found)
    return judged.select(*rows.columns, "status", *[F.col(f"_error.{c}").alias(c) for c in ERROR_COLUMNS])

"""Checks on submitted rows and on the rows of imported files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.amounts import is_finite, parse_amount
from coinbrook.functions.dates import parse_date
from coinbrook.functions.text import PROHIBITED_SYMBOLS, has_prohibited_symbol, is_blank
from coinbrook.operators.duplicates import FILE_KEY, all_present, file_key
from coinbrook.schemas import REQUIRED_FILE_COLUMNS, REQUIRED_FORM_FIELDS

# Texts of the reports.
MISSING_FIELDS = "Missing required fields"
BAD_SYMBOLS = f"Contains prohibited symbols ({PROHIBITED_SYMBOLS})"
NOT_POSITIVE = "Amount must be positive (> 0)"
NOT_A_NUMBER = "Amount must be a valid number"
NOT_A_DATE = "Invalid date format"

# The column a count is about; a file without the column does not report the count.
COUNTED_COLUMN = {
    "non_numeric_amounts": "amount",
    "amounts_not_positive": "amount",
    "bad_descriptions": "description",
    "bad_dates": "date",
}


def validate_rows(submissions: DataFrame) -> DataFrame:
    """Add ``is_valid``, ``missing_fields``, ``error_field``, ``error_reason``, ``error_value``.

    Checks run in order - missing fields, description, amount, date - and a row reports the
    first one it fails. A field whose column is absent is missing in every row.
    """
    have = set(submissions.columns)
    named = [
        F.when(is_blank(F.col(f)) if f in have else F.lit(True), F.lit(f))
        for f in REQUIRED_FORM_FIELDS
    ]
    # array_compact would do, but it is not compiled and slows down the whole projection.
    missing = F.array_except(F.array(*named), F.array(F.lit(None).cast("string")))
    rows = submissions.withColumn("missing_fields", missing)
    check = F.when(F.size("missing_fields") > 0, _error(None, MISSING_FIELDS, None))
    if have >= {"Description", "Amount", "Date"}:
        amount = parse_amount(F.col("Amount"))
        check = (
            check.when(
                has_prohibited_symbol(F.col("Description")),
                _error("Description", BAD_SYMBOLS, F.col("Description")),
            )
            .when(~is_finite(amount), _error("Amount", NOT_A_NUMBER, F.col("Amount")))
            .when(amount <= 0, _error("Amount", NOT_POSITIVE, F.col("Amount")))
            .when(
                parse_date(F.col("Date")).isNull(), _error("Date", NOT_A_DATE, F.col("Date"))
            )
        )
    return (
        rows.withColumn("_error", check)
        .withColumns(
            {
                "is_valid": F.col("_error").isNull(),
                "error_field": F.col("_error.field"),
                "error_reason": F.col("_error.reason"),
                "error_value": F.col("_error.value"),
            }
        )
        .drop("_error")
    )


def _error(field: str | None, reason: str, value: Column | None) -> Column:
    return F.struct(
        F.lit(field).cast("string").alias("field"),
        F.lit(reason).alias("reason"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
    )


def check_file_rows(rows: DataFrame, file: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """One row of findings per file (or for the whole frame), in one pass over normalised rows.

    Counts the rows, missing values per required column, amounts that are no number (a missing
    one included), dates that no format fits, and groups of duplicate rows. ``strict`` adds
    descriptions with prohibited symbols and amounts that are not above zero.

    Rows are first counted by file *and* duplicate key, so that neither a large file nor a row
    copied many times ends up in one task.
    """
    file = list(file)
    have = [c for c in REQUIRED_FILE_COLUMNS if c in rows.columns]
    flags = {f"null_{c}": F.col(c).isNull() for c in have}
    flags["non_numeric_amounts"] = flags["bad_dates"] = F.lit(False)
    if "amount" in have:
        number = parse_amount(F.col("amount"))
        flags["non_numeric_amounts"] = number.isNull()
        if strict:
            flags["amounts_not_positive"] = ~is_finite(number) | (number <= 0)
    if "date" in have:
        flags["bad_dates"] = F.col("date").isNotNull() & parse_date(F.col("date")).isNull()
    if "extra_fields" in rows.columns:
        flags["overlong_rows"] = F.col("extra_fields").isNotNull()
    if strict and "description" in have:
        flags["bad_descriptions"] = has_prohibited_symbol(F.col("description"))

    key = file_key(have)
    counted = rows.select(
        *file,
        *[column.alias(f"_{c}") for c, column in key.items()],
        *[flag.alias(name) for name, flag in flags.items()],
    )
    groups = counted.groupBy(*file, *[f"_{c}" for c in key]).agg(
        F.count("*").alias("_rows"), *[F.count_if(name).alias(name) for name in flags]
    )
    whole_key = len(key) == len(FILE_KEY)
    repeated = (
        (F.col("_rows") > 1) & all_present([f"_{c}" for c in key]) if whole_key else F.lit(False)
    )
    return groups.groupBy(*file).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        F.count_if(repeated).alias("duplicate_groups"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in flags],
    )


def missing_columns(columns: Sequence[str]) -> list[str]:
    """Required columns a normalised header does not have."""
    return [c for c in REQUIRED_FILE_COLUMNS if c not in columns]


def null_columns(findings: Sequence[str]) -> Column:
    """Names of the required columns with missing values, from the counts in ``findings``."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.col(f"null_{c}") > 0, F.lit(c))
                for c in REQUIRED_FILE_COLUMNS
                if f"null_{c}" in findings
            ]
        )
    )


def structure_errors(
    findings: Sequence[str], missing: Column, strict: bool = False
) -> Column:
    """All structural errors of a file as texts, in order; empty for a sound file."""
    nulls = null_columns(findings)
    errors = [
        F.when(
            F.size(missing) > 0, F.concat(F.lit("Missing columns: "), F.concat_ws(", ", missing))
        ),
        F.when(
            (F.size(missing) == 0) & (F.size(nulls) > 0),
            F.concat(F.lit("Null values found in: "), F.concat_ws(", ", nulls)),
        ),
    ]
    counts = {"non_numeric_amounts": "rows have non-numeric amounts"}
    if strict:
        counts["bad_descriptions"] = "rows have prohibited symbols in the description"
        counts["amounts_not_positive"] = "rows have amounts that are not positive"
        counts["bad_dates"] = "rows have dates of unknown format"
    counts["overlong_rows"] = "rows have more fields than the header"
    for name, text in counts.items():
        if name in findings:
            wrong = (F.col(name) > 0) & ~F.array_contains(missing, COUNTED_COLUMN.get(name, ""))
            errors.append(F.when(wrong, F.concat_ws(" ", F.col(name).cast("string"), F.lit(text))))
    return F.array_compact(F.array(*errors))


def validate_file(df: DataFrame, strict: bool = False) -> DataFrame:
    """Structure report of one file read as a frame with a normalised header: one row with
    ``is_valid``, ``errors`` and the counts behind them."""
    findings = check_file_rows(df, strict=strict)
    missing = F.array(*[F.lit(c) for c in missing_columns(df.columns)]).cast("array<string>")
    report = findings.withColumn("errors", structure_errors(findings.columns, missing, strict))
    return report.withColumn("is_valid", F.size("errors") == 0)

"""Text checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols a description must not contain.
PROHIBITED_SYMBOLS = "!@#$%^&*()-=+<>?,./"
PROHIBITED_PATTERN = f"[{re.escape(PROHIBITED_SYMBOLS)}]"

# Cell texts a CSV reader takes for "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def is_blank(text: Column) -> Column:
    """NULL, empty, or nothing but white space of any script."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def has_prohibited_symbol(text: Column) -> Column:
    return text.rlike(PROHIBITED_PATTERN)


def na_to_null(text: Column) -> Column:
    return F.when(~text.isin(NA_TOKENS), text)

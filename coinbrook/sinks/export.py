"""Export of whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame


def export_tables(
    tables: Mapping[str, DataFrame],
    directory: str,
    format: str = "csv",
    as_of: dt.date | None = None,
) -> dict[str, str]:
    """Write each table to ``export_{table}_{YYYY_MM_DD}.{format}`` and return the paths.

    Each path is a directory of part files, written by all tasks in parallel. CSV has a header
    and commas.
    """
    format = format.lower()
    if format not in ("csv", "parquet"):
        raise ValueError(f"export format must be 'csv' or 'parquet', not {format!r}")
    day = (as_of or dt.date.today()).strftime("%Y_%m_%d")
    paths = {}
    for name, table in tables.items():
        path = f"{directory.rstrip('/')}/export_{name}_{day}.{format}"
        writer = table.write.mode("overwrite")
        if format == "csv":
            writer.option("header", True).option("escape", '"').csv(path)
        else:
            writer.parquet(path)
        paths[name] = path
    return paths

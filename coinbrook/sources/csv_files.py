"""CSV files whose headers may differ, read as text columns under normalised names."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coinbrook.functions.text import na_to_null
from coinbrook.operators.normalize import column_name
from coinbrook.operators.validation import missing_columns
from coinbrook.schemas import EXPENSES_LINE
from coinbrook.sources.csv_records import opens_cell, read_lines, read_records
from coinbrook.sources.local import local_frame

KNOWN_COLUMNS = EXPENSES_LINE.fieldNames()
#: What stands beyond the header's fields in a record whose quoted cell never ends.
UNCLOSED = "a quoted cell is open at the end of the file"


@dataclass(frozen=True)
class CsvFile:
    """One file as found: ``file`` is its key in row frames, ``path`` is what a reader takes."""

    file: str
    path: str
    filename: str
    arrival: int | None
    labels: tuple[str, ...]
    columns: tuple[str, ...]
    line_breaks_in_cells: bool


def find_files(
    spark: SparkSession, paths: Sequence[str], glob: str = "*", check_line_breaks: bool = True
) -> list[CsvFile]:
    """List the files under the paths with their headers, and whether a quoted cell spans lines.

    One pass over the lines, as plain text. With ``check_line_breaks=False`` the caller vouches
    that no cell holds a line break. One entry per file comes to the driver, no more than Spark's
    own file listing keeps there.
    """
    present = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(list(paths))
    listing = present.select(
        "path",
        F.unix_micros("modificationTime").alias("arrival"),
        F.col("_metadata.file_path").alias("file"),
    )
    lines = read_lines(spark, paths, pathGlobFilter=glob)
    at_top = (F.col("block") == 0) & F.col("value").rlike(r"\S")
    broken = opens_cell(F.col("value")) if check_line_breaks else F.lit(False)
    heads = lines.groupBy("file").agg(
        F.min_by(F.when(at_top, F.col("value")), F.when(at_top, F.col("line"))).alias("header"),
        F.max(broken).alias("broken"),
    )
    found = []
    for row in listing.join(heads, "file", "left").orderBy("arrival", "file").collect():
        labels = _labels(row["header"])
        found.append(
            CsvFile(
                file=row["file"],
                path=row["path"],
                filename=row["path"].rsplit("/", 1)[-1],
                arrival=row["arrival"],
                labels=labels,
                columns=_columns(labels),
                line_breaks_in_cells=bool(row["broken"]),
            )
        )
    # A scan passes over files without a single byte; they are files all the same.
    scanned = {f.file for f in found}
    everything = {re.sub("^file:/+", "file:/", f) for f in present.inputFiles()}
    for file in sorted(everything - scanned):
        path = unquote(file)
        found.append(CsvFile(file, path, path.rsplit("/", 1)[-1], None, (), (), False))
    return found


def _labels(header: str | None) -> tuple[str, ...]:
    if header is None:
        return ()
    return tuple(next(csv.reader([header.lstrip("\ufeff").rstrip("\r")])))


def _columns(labels: Sequence[str]) -> tuple[str, ...]:
    columns = [column_name(c) for c in labels]
    if "towards" not in columns:
        columns = ["towards" if c == "to_account" else c for c in columns]
    return tuple(columns)


def file_frame(spark: SparkSession, files: Sequence[CsvFile]) -> DataFrame:
    """The found files as a frame: file, filename, arrival, missing_columns."""
    rows = [(f.file, f.filename, f.arrival, missing_columns(f.columns)) for f in files]
    return local_frame(
        spark,
        rows,
        "file string, filename string, arrival bigint, missing_columns array<string>",
    )


def read_files(spark: SparkSession, files: Sequence[CsvFile]) -> DataFrame:
    """Rows of the files as text, with ``file`` and the known columns.

    A column a file lacks is NULL in its rows, except that ``has_id`` and ``has_category`` tell a
    missing column from empty cells. ``extra_fields`` holds what a row has beyond its header.
    Files are read together by layout, that is by where the known columns stand. Files with line
    breaks inside cells take the way of ``read_records``, so that they are split as well.
    """
    layouts: dict[tuple, list[str]] = defaultdict(list)
    for f in files:
        if f.columns:
            places = tuple(f.columns.index(c) if c in f.columns else None for c in KNOWN_COLUMNS)
            layouts[(len(f.columns), places, f.line_breaks_in_cells)].append(f.path)
    frames = [_read_layout(spark, *layout, paths) for layout, paths in layouts.items()]
    if not frames:
        return local_frame(spark, [], _row_schema())
    return reduce(DataFrame.unionByName, frames)


def _row_schema() -> T.StructType:
    text = ["file", *KNOWN_COLUMNS, "extra_fields"]
    flags = ["has_id", "has_category"]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in text]
        + [T.StructField(c, T.BooleanType()) for c in flags]
    )


def _read_layout(
    spark: SparkSession, width: int, places: tuple, multi_line: bool, paths: Sequence[str]
) -> DataFrame:
    known = [
        (F.lit(None).cast("string") if at is None else na_to_null(F.col(f"c{at}"))).alias(name)
        for name, at in zip(KNOWN_COLUMNS, places)
    ]
    has = dict(zip(KNOWN_COLUMNS, places))
    return _read_cells(spark, width, multi_line, paths).select(
        "file",
        *known,
        F.col(f"c{width}").alias("extra_fields"),
        F.lit(has["id"] is not None).alias("has_id"),
        F.lit(has["category"] is not None).alias("has_category"),
    )


def _read_cells(
    spark: SparkSession, width: int, multi_line: bool, paths: Sequence[str]
) -> DataFrame:
    """Cells by position as ``c0``, ``c1`` ..., one more than the header has, and ``file``.

    A record that its file leaves open has ``UNCLOSED`` as the further one, so it counts as a row
    with more fields than the header, and its file as badly structured.
    """
    cells = ", ".join(f"c{i} string" for i in range(width + 1))
    paths = [_plain_path(p) for p in paths]
    if multi_line:
        record = F.from_csv("record", cells, {"escape": '"'}).alias("_cells")
        rows = read_records(spark, paths).select("file", record, "unclosed")
        cells_of = [F.col(f"_cells.c{i}") for i in range(width)]
        extra = F.when(F.col("unclosed"), F.lit(UNCLOSED)).otherwise(F.col(f"_cells.c{width}"))
        return rows.select("file", *cells_of, extra.alias(f"c{width}"))
    raw = spark.read.schema(cells).options(header=True, escape='"').csv(paths)
    return raw.withColumn("file", F.col("_metadata.file_path"))


def _plain_path(path: str) -> str:
    """A path that readers take literally, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file (or a directory of equal ones) as text columns under its own header names.

    A quoted cell that is open at the end of a file is an error when the rows are read.
    """
    files = find_files(spark, [path])
    headers = {f.labels for f in files if f.labels}
    if len(headers) != 1:
        raise ValueError(f"{path} has {len(headers)} different headers, expected one")
    labels = headers.pop()
    frames = []
    for multi_line in (False, True):
        paths = [f.path for f in files if f.labels and f.line_breaks_in_cells == multi_line]
        if paths:
            raw = _read_cells(spark, len(labels), multi_line, paths)
            if multi_line:
                # A filter is never pruned, so no action passes over lines that are left out.
                unclosed = F.col(f"c{len(labels)}") == UNCLOSED
                raw = raw.filter(F.when(unclosed, F.raise_error(F.lit(UNCLOSED)).cast("boolean")).otherwise(True))
            cells = [na_to_null(F.col(f"c{i}")).alias(c) for i, c in enumerate(labels)]
            frames.append(raw.select(*cells))
    return reduce(DataFrame.unionByName, frames)

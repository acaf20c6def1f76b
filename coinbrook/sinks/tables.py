"""The stored tables of a ledger, as catalog tables in one database.

Partitioning: raw rows, log rows and reports by batch, so that a repeated batch replaces its own
partition; the fact table by year, which is what date filters prune on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coinbrook.operators.duplicates import ROW_KEY
from coinbrook.operators.quarantine import ERROR_COLUMNS
from coinbrook.schemas import (
    DIM_ACCOUNT,
    EXPENSES_LINE,
    FCT_EXPENSE,
    FORM_LABELS,
    INTEGRITY_FILE_IMPORTED,
)

_BATCH = T.StructField("batch_id", T.StringType())
_FILE = T.StructField("source_file", T.StringType())
_CHECKED = [
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("missing_fields", T.ArrayType(T.StringType())),
    T.StructField("error_field", T.StringType()),
    T.StructField("error_reason", T.StringType()),
    T.StructField("error_value", T.StringType()),
]
_VERDICT = [T.StructField("status", T.StringType()), T.StructField("duplicate_of", T.StringType())]
FORM_FIELDS = list(FORM_LABELS)
_FORM = [T.StructField(f.replace(" ", "_"), T.StringType()) for f in FORM_FIELDS]
_KEY_TYPES = {"key_date": T.DateType(), "key_amount": T.DoubleType()}
_KEY = [T.StructField(k, _KEY_TYPES.get(k, T.StringType())) for k in ROW_KEY]
_ENTRY = [T.StructField("submission_id", T.StringType()), T.StructField("entry", T.LongType())]

# Physical tables: columns and partition column. The fact table is stored under a version number
# (``fct_expense_v1`` ...) behind a view, see ``swap_fact``.
STORED = {
    "expenses_line": (T.StructType([*EXPENSES_LINE, _FILE, _BATCH]), "batch_id"),
    "integrity_file_imported": (T.StructType([*INTEGRITY_FILE_IMPORTED, _BATCH]), "batch_id"),
    "dim_account": (DIM_ACCOUNT, None),
    "submission": (T.StructType([*_ENTRY, *_FORM, *_CHECKED, *_KEY, _BATCH]), "batch_id"),
    "submission_report": (
        T.StructType([*_ENTRY, *_FORM, *_CHECKED, *_VERDICT, _BATCH]),
        "batch_id",
    ),
    # Rows of rejected files as they were read, with what is wrong with them.
    "quarantine": (
        T.StructType(
            [T.StructField("file", T.StringType())]
            + [T.StructField(f.name, T.StringType()) for f in EXPENSES_LINE]
            + [T.StructField("extra_fields", T.StringType()), T.StructField("status", T.StringType())]
            + [T.StructField(c, T.StringType()) for c in ERROR_COLUMNS]
            + [_BATCH]
        ),
        "batch_id",
    ),
    # Batches that have begun and not ended; readers pass over their rows.
    "open_batch": (
        T.StructType([T.StructField("begun", T.TimestampType()), _BATCH]),
        "batch_id",
    ),
    "batch_file": (
        T.StructType(
            [T.StructField("file", T.StringType()), T.StructField("arrival", T.LongType()), _BATCH]
        ),
        "batch_id",
    ),
    "file_report": (
        T.StructType(
            [
                T.StructField("file", T.StringType()),
                T.StructField("filename", T.StringType()),
                T.StructField("status", T.StringType()),
                T.StructField("row_count", T.LongType()),
                T.StructField("duplicate_groups", T.LongType()),
                T.StructField("bad_dates", T.LongType()),
                T.StructField("errors", T.ArrayType(T.StringType())),
                T.StructField("imported_as", T.StringType()),
                T.StructField("date_order", T.StringType()),
                _BATCH,
            ]
        ),
        "batch_id",
    ),
}

# The maintained mart: partial sums by batch and year, see ``plans.cells``, and which batches are in.
_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


MART_STORED = {
    "mart_cell": (
        _struct(
            ("kpi", _TEXT),
            ("month", _INT),
            ("month_year_marker", _TEXT),
            ("parent_category", _TEXT),
            ("num_day_of_week", _INT),
            ("day_of_week", _TEXT),
            ("season", _TEXT),
            ("from_account_marker", _TEXT),
            ("category_tag", _TEXT),
            ("towards_category", _TEXT),
            ("expense_date", T.DateType()),
            ("high", _LONG),
            ("low", _LONG),
            ("beyond", _DOUBLE),
            ("present", _LONG),
            ("rows", _LONG),
            ("batch_id", _TEXT),
            ("year", _INT),
        ),
        "batch_id, year",
    ),
    "mart_top": (
        _struct(
            ("year", _INT),
            ("id", _TEXT),
            ("expense_date", T.DateType()),
            ("description", _TEXT),
            ("parent_category", _TEXT),
            ("expend_amount", _DOUBLE),
            ("batch_id", _TEXT),
        ),
        "batch_id",
    ),
    "day_split": (
        _struct(
            ("day", T.DateType()),
            ("day_rows", _LONG),
            ("splits", _INT),
            ("split", _INT),
            ("units", T.DecimalType(38, 0)),
            ("beyond", _DOUBLE),
            ("batch_id", _TEXT),
        ),
        "batch_id",
    ),
    "mart_batch": (_struct(("counted_rows", _LONG), ("batch_id", _TEXT)), "batch_id"),
    # ``batch_id`` is the merged batch, ``member`` one of those that it stands for.
    "mart_merge": (_struct(("member", _TEXT), ("batch_id", _TEXT)), "batch_id"),
}

_RECORD = T.StructType(
    [
        T.StructField("id", _TEXT),
        T.StructField("expense_date", T.DateType()),
        T.StructField("description", _TEXT),
        T.StructField("expend_amount", _DOUBLE),
        T.StructField("parent_category", _TEXT),
        T.StructField("from_account_marker", _TEXT),
        T.StructField("towards_category", _TEXT),
    ]
)
_LOGGED = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("id", _TEXT),
        T.StructField("filename", _TEXT),
        T.StructField("date_imported", _TEXT),
        T.StructField("no_of_rows_imported", _INT),
    ]
)

# Indexes for the checks against history, see ``operators.key_history`` and ``operators.name_index``.
INDEX_STORED = {
    "fact_key": (
        T.StructType([T.StructField("key_text", _TEXT), T.StructField("record", _RECORD), _BATCH]),
        "batch_id",
    ),
    "id_word": (
        _struct(("words", _LONG), ("word", _LONG), ("bits", _LONG), ("batch_id", _TEXT)),
        "batch_id",
    ),
    "log_gram": (
        T.StructType(
            [
                T.StructField("gram", _TEXT),
                T.StructField("filename", _TEXT),
                T.StructField("record", _LOGGED),
                _BATCH,
                T.StructField("part", _INT),
            ]
        ),
        "batch_id, part",
    ),
}
#: Buckets of a new ``fact_key`` table: about one for each 200 MB that it is to hold.
KEY_BUCKETS = 16

# What a user sees; the rest is bookkeeping.
USER_TABLES = {
    "expenses_line": [f.name for f in EXPENSES_LINE],
    "fct_expense": [f.name for f in FCT_EXPENSE],
    "dim_account": [f.name for f in DIM_ACCOUNT],
    "integrity_file_imported": [f.name for f in INTEGRITY_FILE_IMPORTED],
}


def _checked(batch_id: str) -> str:
    if not re.fullmatch(r"[\w.:-]+", batch_id):
        raise ValueError(f"batch id {batch_id!r} has characters other than letters, digits, _.:-")
    return batch_id


class LedgerTables:
    """Create, read and write the tables of one database."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark = spark
        self.database = database
        self.location = location.rstrip("/") if location else None

    def open(self) -> "LedgerTables":
        """Create what does not exist; existing tables and their rows stay as they are."""
        at = f" LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}{at}")
        for name, (schema, partition) in STORED.items():
            self._create(name, schema, partition)
        if not self.spark.catalog.tableExists(self._name("fct_expense")):
            self.swap_fact(self.spark.createDataFrame([], FCT_EXPENSE))
        return self

    def open_mart(self) -> None:
        """Create the tables of the maintained mart where they do not exist."""
        for name, (schema, partition) in MART_STORED.items():
            self._create(name, schema, partition)

    def open_indexes(self, key_buckets: int = KEY_BUCKETS) -> None:
        """Create the index tables where they do not exist."""
        for name, (schema, partition) in INDEX_STORED.items():
            buckets = f" CLUSTERED BY (key_text) INTO {key_buckets} BUCKETS" if name == "fact_key" else ""
            self._create(name, schema, partition, buckets)

    def buckets(self, table: str) -> int:
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self._name(table)}").collect()
        return next(int(r["data_type"]) for r in rows if r["col_name"] == "Num Buckets")

    def _name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def _create(
        self, table: str, schema: T.StructType, partition: str | None, buckets: str = ""
    ) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f" PARTITIONED BY ({partition})" if partition else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}) USING parquet{by}{buckets}"
        )

    def names(self) -> list[str]:
        """The tables a user sees."""
        listed = {t.name for t in self.spark.catalog.listTables(self.database)}
        return [t for t in USER_TABLES if t in listed]

    def read(self, table: str, without: Sequence[str] = ()) -> DataFrame:
        """A whole table, but for the partitions of the batches ``without``: the documented columns of
        a user table, all columns of the others."""
        frame = self.spark.table(self._name(table))
        if without:
            frame = frame.filter(~F.col("batch_id").isin(list(without)))
        return frame.select(*USER_TABLES[table]) if table in USER_TABLES else frame

    def read_batch(self, table: str, batch_id: str) -> DataFrame:
        """All columns of one batch; only its partition is read."""
        frame = self.spark.table(self._name(table))
        return frame.filter(frame["batch_id"] == batch_id)

    def has_batch(self, table: str, batch_id: str) -> bool:
        """Does the catalog know a partition of the batch? No data is read."""
        spec = f"PARTITION (batch_id = '{_checked(batch_id)}')"
        return not self.spark.sql(f"SHOW PARTITIONS {self._name(table)} {spec}").isEmpty()

    def write_batch(self, table: str, frame: DataFrame, batch_id: str) -> None:
        """Write the rows of one batch in place of any earlier ones of that batch. The catalog
        gets the partition when all of it is written, so it shows up complete or not at all."""
        columns = [c for c in self.spark.table(self._name(table)).columns if c != "batch_id"]
        # Any further partition column is the last of the columns.
        _, partition = (STORED | MART_STORED | INDEX_STORED)[table]
        further = partition.removeprefix("batch_id")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self._name(table)} "
            f"PARTITION (batch_id = '{_checked(batch_id)}'{further}) SELECT * FROM {{rows}}",
            rows=frame.select(*columns),
        )

    def drop_batch(self, table: str, batch_id: str) -> None:
        """Drop the partitions of a batch."""
        for values in self.partitions(table):
            if values["batch_id"] == batch_id:
                spec = ", ".join(f"{n} = null" if v is None else f"{n} = '{v}'" for n, v in values.items())
                self.spark.sql(f"ALTER TABLE {self._name(table)} DROP IF EXISTS PARTITION ({spec})")

    def partitions(self, table: str) -> list[dict[str, str | None]]:
        """The values of the partition columns of each partition."""
        found = []
        for row in self.spark.sql(f"SHOW PARTITIONS {self._name(table)}").collect():
            values = dict(part.split("=", 1) for part in row["partition"].split("/"))
            found.append({n: None if v == "__HIVE_DEFAULT_PARTITION__" else v for n, v in values.items()})
        return found

    def batches(self, table: str) -> set[str]:
        return {values["batch_id"] for values in self.partitions(table)}

    def append(self, table: str, frame: DataFrame, columns: Sequence[str]) -> None:
        frame.select(*columns).write.mode("append").insertInto(self._name(table))

    def version(self, view: str) -> int:
        """Version number of the table behind a view; 0 before the first."""
        if not self.spark.catalog.tableExists(self._name(view)):
            return 0
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._name(view)} ('version')")
        return int(rows.first()["value"])

    def fact_version(self) -> int:
        return self.version("fct_expense")

    def swap_mart(self, mart: DataFrame) -> None:
        """Write a new KPI mart, then let the view ``kpi_mart`` point to it, as for the facts."""
        old = self.version("kpi_mart")
        new = old + 1
        table = self._name(f"kpi_mart_v{new}")
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        mart.write.partitionBy("kpi").format("parquet").saveAsTable(table)
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self._name('kpi_mart')} "
            f"TBLPROPERTIES ('version' = '{new}') AS SELECT * FROM {table}"
        )
        if old > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'kpi_mart_v{old - 1}')}")

    def path(self, table: str) -> str:
        """The folder of a table."""
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self._name(table)}").collect()
        return next(r["data_type"] for r in rows if r["col_name"] == "Location")

    def read_live(self, epoch: int) -> DataFrame | None:
        """The live KPIs before a micro-batch; None before the first."""
        # The micro-batch is repeated if its version is there already; it starts from the one before.
        version = min(self.version("live_kpi"), epoch)
        return self.spark.table(self._name(f"live_kpi_v{version}")) if version else None

    def swap_live(self, kpis: DataFrame, epoch: int) -> None:
        """Write the live KPIs after a micro-batch, then let the view ``live_kpi`` point to them."""
        version = epoch + 1
        table = self._name(f"live_kpi_v{version}")
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        # A shuffle: with coalesce, all tasks before it would run as one.
        kpis.repartition(1).write.format("parquet").saveAsTable(table)
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self._name('live_kpi')} "
            f"TBLPROPERTIES ('version' = '{version}') AS SELECT * FROM {table}"
        )
        if version > 2:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'live_kpi_v{version - 2}')}")

    def drop_live(self) -> None:
        """Forget the live KPIs, for a stream that starts anew."""
        version = self.version("live_kpi")
        self.spark.sql(f"DROP VIEW IF EXISTS {self._name('live_kpi')}")
        for old in range(max(1, version - 1), version + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'live_kpi_v{old}')}")

    def swap_fact(self, fact: DataFrame) -> None:
        """Write a whole new fact table, then let the view ``fct_expense`` point to it.

        Readers see the old table until the moment the new one is complete. The version before
        it is kept for queries still running on it, older ones are dropped.
        """
        old = self.fact_version()
        new = old + 1
        table = f"fct_expense_v{new}"
        # A table of that name can only be left over from a job that died before its swap.
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
        self._create(table, FCT_EXPENSE, "year")
        self._insert_fact(table, fact)
        columns = ", ".join(USER_TABLES["fct_expense"])
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self._name('fct_expense')} "
            f"TBLPROPERTIES ('version' = '{new}') "
            f"AS SELECT {columns} FROM {self._name(table)}"
        )
        if old > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'fct_expense_v{old - 1}')}")

    def add_facts(self, fact: DataFrame) -> None:
        """Append rows to the fact table in use."""
        self._insert_fact(f"fct_expense_v{self.fact_version()}", fact)

    def _insert_fact(self, table: str, fact: DataFrame) -> None:
        # REBALANCE gathers the rows of a year into files of good size, and splits a year that
        # holds more than its share.
        columns = self.spark.table(self._name(table)).columns
        self.append(table, fact.hint("rebalance", "year"), columns)

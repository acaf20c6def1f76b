"""What the operators share: settings, tables, and the schemas of Arrow functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

import coinbrook
from coinbrook.session import tune

Batches = Iterator[pa.RecordBatch]

#: Rows handed to Python at a time. Texts are whole, so few rows keep a worker's memory small.
ROWS_PER_BATCH = 256


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed. Once for a context."""
    package = os.path.dirname(os.path.abspath(coinbrook.__file__))
    app = spark.sparkContext.applicationId
    if app in _shipped or not os.path.isdir(package):
        return
    folder = tempfile.mkdtemp(prefix="coinbrook-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(
        os.path.join(folder, "coinbrook"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def ready(spark: SparkSession) -> SparkSession:
    """Apply the settings that the operators rely on, and send their code to the executors."""
    tune(spark)
    _ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(frame: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of the frame, whatever the case of the letters."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_arrow(frame: DataFrame, step: Callable[[Batches], Batches], schema: str, **carried: DataType) -> DataFrame:
    """``mapInArrow`` with a schema text, before it the columns that are only carried along."""
    kept = StructType([StructField(name, kind) for name, kind in carried.items()])
    return frame.mapInArrow(step, StructType(kept.fields + StructType.fromDDL(schema).fields))


def batch(names_and_values: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A record batch of the columns in ``types``, in that order."""
    arrays = [
        v if isinstance(v := names_and_values[n], pa.Array) else pa.array(v, t)
        for n, t in types.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


#: Sides of a join with up to so many rows of a few longs are sent to all tasks: 64 MB at most.
SENT_ROWS = 1 << 21


def sent_if_small(stored: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A stored frame of narrow rows, marked for broadcast if a count shows that they are few.

    Otherwise Spark is left to shuffle both sides.
    """
    return F.broadcast(stored) if stored.limit(rows + 1).count() <= rows else stored


def one_per_key(frame: DataFrame, key: str) -> DataFrame:
    """One row of each value of ``key``, null included.

    Keys are expected to be unique already. Only the rows of repeated keys are shuffled with all
    their columns; the others are passed on where they are if Spark can broadcast the repeated keys.
    """
    repeated = frame.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key")
    repeated = repeated.withColumn("_repeated", F.lit(True))
    marked = frame.join(repeated, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    single = marked.filter("_repeated is null").drop("_repeated")
    several = marked.filter("_repeated").drop("_repeated").dropDuplicates([key])
    return single.unionByName(several)

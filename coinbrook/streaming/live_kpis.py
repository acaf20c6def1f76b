"""KPIs of categories and months, brought up to date by a stream over the rows that land.

The sums of every group are kept in the state store, so a micro-batch reads the new rows alone and
hands on the groups that changed. These replace their older rows in a small table, which readers see
through a view. A micro-batch that Spark repeats writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coinbrook.functions.amounts import money_parts, money_total
from coinbrook.plans.fact import build_fact
from coinbrook.plans.kpis import AMOUNT
from coinbrook.plans.ledger import Ledger
from coinbrook.plans.mart import KPI_KEYS
from coinbrook.schemas import EXPENSES_LINE
from coinbrook.sinks.scratch import materialize

#: KPIs that the stream keeps, with their group keys.
LIVE_KPIS = {name: KPI_KEYS[name] for name in ("category", "monthly")}
LIVE_KEYS = [key for keys in LIVE_KPIS.values() for key in keys]
_PARTS = ["high", "low", "beyond"]


def _groups(facts: DataFrame) -> DataFrame:
    """A row for each KPI that an expense belongs to; expenses with a missing key belong to none."""
    rows = [
        F.when(
            F.col(keys[0]).isNotNull(),
            F.struct(
                F.lit(name).alias("kpi"),
                *[(F.col(k) if k in keys else F.lit(None).cast(facts.schema[k].dataType)).alias(k) for k in LIVE_KEYS],
            ),
        )
        for name, keys in LIVE_KPIS.items()
    ]
    parts = [part.alias(name) for name, part in zip(_PARTS, money_parts(F.col(AMOUNT)))]
    each = facts.select(F.explode(F.array_compact(F.array(*rows))).alias("group"), *parts)
    return each.select("group.*", *_PARTS)


def kpi_stream(
    ledger: Ledger, checkpoint: str, files_per_batch: int = 1000, trigger: dict | None = None
) -> StreamingQuery:
    """Start the stream; the default trigger takes what has landed and stops.

    It reads the raw table's files as they appear, rows of batches that have not ended included. A
    ledger has one such stream; a new checkpoint needs ``drop_live`` of its tables first.
    """
    spark = ledger.spark
    lines = (
        spark.readStream.schema(EXPENSES_LINE)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(ledger.tables.path("expenses_line"))
    )
    sums = _groups(build_fact(lines, ledger.as_of)).groupBy("kpi", *LIVE_KEYS)
    sums = sums.agg(*[F.sum(p).alias(p) for p in _PARTS], F.count("*").alias("transactions"))

    def put(changed: DataFrame, epoch: int) -> None:
        changed = changed.select(
            "kpi", *LIVE_KEYS, money_total(*[F.col(p) for p in _PARTS]).alias("total"), "transactions"
        )
        # Stored, so that the state is read and written once, each of its partitions in a task of its own.
        changed = materialize(changed, "changed").withColumn("_group", F.struct("kpi", *LIVE_KEYS))
        before = ledger.tables.read_live(epoch)
        if before is not None:
            older = before.withColumn("_group", F.struct("kpi", *LIVE_KEYS))
            older = older.join(changed.select("_group"), "_group", "left_anti")
            changed = older.unionByName(changed)
        ledger.tables.swap_live(changed.drop("_group"), epoch)

    return (
        sums.writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_kpi(ledger: Ledger, kpi: str) -> DataFrame:
    """One KPI as the stream has it: its keys, ``total`` and ``transactions``."""
    live = ledger.spark.table(f"{ledger.tables.database}.live_kpi")
    return live.filter(F.col("kpi") == kpi).select(*LIVE_KPIS[kpi], "total", "transactions")

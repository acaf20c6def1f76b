"""Import files as they arrive in a landing directory."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from coinbrook.plans.ledger import Ledger


def import_stream(
    ledger: Ledger,
    landing: str,
    checkpoint: str,
    glob: str = "*.csv",
    files_per_batch: int = 1000,
    trigger: dict | None = None,
    name: str = "landing",
    **options,
) -> StreamingQuery:
    """Start a stream that imports each new file under the landing directory.

    The stream carries file paths only; each micro-batch runs the ordinary file import on them.
    The batch id follows from the id that the stream keeps in its checkpoint and the micro-batch
    number, so a micro-batch that Spark repeats after a failure is not imported twice, and streams
    with other checkpoints, or a new checkpoint under an old name, have batches of their own. Whether
    a name was imported before is still decided by the import log, over all history. Files beyond
    ``files_per_batch`` wait for the next micro-batch. The default trigger takes what is there and
    stops.
    """
    arrivals = (
        ledger.spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select("path")
    )

    def stream_id() -> str:
        kept = ledger.spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True)
        return json.loads(kept.first()["value"])["id"]

    def import_batch(batch: DataFrame, number: int) -> None:
        paths = [row["path"] for row in batch.toLocalIterator()]
        if paths:
            ledger.import_files(paths, f"{name}-{stream_id()}-{number}", **options)

    return (
        arrivals.writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

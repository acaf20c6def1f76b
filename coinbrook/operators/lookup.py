"""Joins between a large history and one batch, in the shape that moves the least data.

Spark splits a hot key of a join over many tasks, but only where both sides of the join are
shuffled for the join itself. A side that comes out of an aggregate on the same key is not: it is
taken as it lies. The joins here therefore add a hash of the key to the join columns. It changes
no result; it makes Spark shuffle the aggregated side again, which is small next to the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASH = "_key_hash"


def _hashed(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.withColumn(_HASH, F.xxhash64(*keys))


def seen_before(history: DataFrame, batch_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the history whose key occurs in the batch.

    The batch is the side Spark may broadcast: where its size is below the broadcast threshold
    the history is only scanned, not shuffled. Above it both sides shuffle on the key, copies of
    a batch key collapse before that, and a hot key of the history is split.
    """
    distinct = _hashed(batch_keys.select(*keys).distinct(), keys)
    return _hashed(history, keys).join(distinct, [*keys, _HASH], "left_semi").drop(_HASH)


def absent_from(batch: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the history does not have (a missing key is never had).

    The history is first cut down to the keys of the batch, so only as many rows as the batch
    has keys meet it in the second join.
    """
    present = _hashed(seen_before(history, batch, keys).select(*keys).distinct(), keys)
    return _hashed(batch, keys).join(present, [*keys, _HASH], "left_anti").drop(_HASH)


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join facts that are unique per key to all rows of that key; the rows of a hot key
    are split."""
    return _hashed(rows, keys).join(_hashed(per_key, keys), [*keys, _HASH], "left").drop(_HASH)

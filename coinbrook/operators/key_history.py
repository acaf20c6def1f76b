"""Duplicate lookup against a history that lies ready by key.

The six columns of a key become one text, by which the stored history is bucketed. A batch of entries
is shuffled to the buckets; the history stays where it is and is read without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.operators.duplicates import ROW_KEY, all_present, with_fact_key


def _amount() -> Column:
    """One zero instead of two."""
    return F.when(F.col("key_amount") == 0, 0.0).otherwise(F.col("key_amount"))


def key_text() -> Column:
    """The key as one text, NULL if a column of it is missing. Each part is written with its length
    before it, so different keys have different texts; equal amounts have equal ones."""
    parts = [_amount().cast("string") if k == "key_amount" else F.col(k).cast("string") for k in ROW_KEY]
    written = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.when(all_present(ROW_KEY), F.concat(*written))


def keys_of(fact: DataFrame, buckets: int) -> DataFrame:
    """Rows for the key history: each key once, with the record of the lowest id. Copies collapse
    before they are shuffled. Dealt out as the table is bucketed, so that a bucket is one file."""
    keyed = with_fact_key(fact).select(key_text().alias("key_text"), "record").filter("key_text is not null")
    return keyed.groupBy("key_text").agg(F.min("record").alias("record")).repartition(buckets, "key_text")


def matching_keys(keyed_submissions: DataFrame, history: DataFrame) -> DataFrame:
    """As ``duplicates.matching_facts``, from the key history of all batches. What is joined is the
    batch's keys, one row each; a hot key of the history has one row for each of its batches."""
    own = keyed_submissions.select(*ROW_KEY, key_text().alias("key_text")).filter("key_text is not null")
    own = own.withColumn("key_amount", _amount())
    wanted = own.groupBy("key_text").agg(*[F.first(k).alias(k) for k in ROW_KEY])
    hits = history.select("key_text", "record").join(wanted, "key_text")
    return hits.groupBy("key_text").agg(
        *[F.first(k).alias(k) for k in ROW_KEY], F.min("record").alias("duplicate_of")
    ).drop("key_text")

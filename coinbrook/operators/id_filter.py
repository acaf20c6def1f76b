"""Which ids of a batch may be in the history? Told from Bloom filters that are stored as rows.

The filter of a stored batch is a table of words of 32 bits: each id sets ``HASHES`` bits, and a word is
kept with the bits that are set in it. It takes about a tenth of the ids themselves. An id is looked up
by its words; one that is there has all its bits set, another one by chance in about one of a hundred
cases. Only batches with such hits are read to confirm them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
#: Bits for each id of a batch.
BITS_PER_ID = 10


def _places(id_: str, words: Column) -> Column:
    """Word and bit of each hash of an id, for a filter of so many words."""
    hashes = F.array(*[F.xxhash64(F.col(id_), F.lit(k)) for k in range(HASHES)])
    return F.transform(
        hashes,
        lambda h: F.struct(
            F.pmod(F.shiftright(h, 5), words).alias("word"),
            F.pow(F.lit(2.0), F.pmod(h, F.lit(32))).cast("long").alias("bit"),
        ),
    )


def filter_of(ids: DataFrame) -> DataFrame:
    """The filter of the ids of a batch: ``words`` (how many it has), ``word``, ``bits``. Reads the ids
    twice, for their number and for their bits; what is shuffled is words, combined within tasks. The
    number of words is a power of two, so that there are few sizes to look an id up in."""
    present = ids.select("id").filter("id is not null")
    rows = present.agg(F.count("*").alias("_rows"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("_rows") * BITS_PER_ID / 32))
    words = F.pow(F.lit(2.0), F.ceil(F.log2(needed.cast("double")))).cast("long")
    bits = present.withColumn("words", rows.select(words).scalar()).select("words", F.explode(_places("id", F.col("words"))).alias("at"))
    return bits.groupBy("words", F.col("at.word").alias("word")).agg(F.bit_or("at.bit").alias("bits"))


def may_be_known(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """``id`` and ``batch_id`` of the ids that a stored batch may hold, and all that it does hold.

    ``filters`` are the words of all batches with their ``batch_id``. Each id is looked up in each
    filter size that occurs: powers of two, so some dozens at most.
    """
    sizes = filters.agg(F.collect_set("words"))
    asked = ids.select("id").filter("id is not null").distinct()
    asked = asked.select("id", F.explode(sizes.scalar()).alias("words"))
    asked = asked.select("id", "words", F.explode(F.array_distinct(_places("id", F.col("words")))).alias("at"))
    asked = asked.groupBy("id", "words", F.col("at.word").alias("word")).agg(F.bit_or("at.bit").alias("asked"))
    met = asked.join(filters, ["words", "word"]).filter("(bits & asked) = asked")
    counted = met.groupBy("id", "words", "batch_id").agg(F.count("*").alias("_met"))
    wanted = asked.groupBy("id", "words").agg(F.count("*").alias("_wanted"))
    return counted.join(wanted, ["id", "words"]).filter("_met = _wanted").select("id", "batch_id").distinct()

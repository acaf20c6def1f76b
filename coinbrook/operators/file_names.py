"""Has a file of this name been imported before?

The rule is ``logged LIKE '%' || name || '%'`` with ``_`` in the name standing for any one
character and ``%`` for any run of them. Comparing every name with every log row would be a
nested loop. Instead a name is looked up by its longest part without wild cards: each log row is
cut into its substrings of the lengths in question, these meet the parts in an equality join, and
the whole rule is checked on the pairs that meet. The plan does not depend on the names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An escape character no file name has: backslashes in names stay plain characters.
ESCAPE = "\\u0001"


def find_logged(
    names: DataFrame, log: DataFrame, info: Sequence[str], match: str = "contains"
) -> DataFrame:
    """Add ``hit`` to each name: the first log row (lowest ``info``) that blocks it, or NULL.

    ``match="contains"`` is the LIKE rule above; ``match="exact"`` asks for the same name.
    """
    distinct = names.select("filename").distinct()
    record = F.struct(*[F.col(c) for c in info])
    logged = log.select(F.col("filename").alias("_logged"), record.alias("_record"))
    if match == "exact":
        logged = logged.groupBy("_logged").agg(F.min("_record").alias("_record"))
        pairs = distinct.join(logged, F.col("filename") == F.col("_logged"))
    elif match == "contains":
        pairs = _containing(distinct, logged)
    else:
        raise ValueError(f"match must be 'contains' or 'exact', not {match!r}")
    first = pairs.groupBy("filename").agg(F.min("_record").alias("hit"))
    # With a hash of the name, so that the rows of a hot name are split; see ``lookup``.
    keyed = first.withColumn("_hash", F.xxhash64("filename"))
    rows = names.withColumn("_hash", F.xxhash64("filename"))
    return rows.join(keyed, ["filename", "_hash"], "left").drop("_hash")


def _containing(names: DataFrame, logged: DataFrame) -> DataFrame:
    parts = names.select("filename", longest_part(F.split("filename", "[_%]")).alias("_part"))
    # One row: the lengths of the parts, none longer than a file name may be.
    lengths = parts.agg(F.collect_set(F.length("_part")).alias("_lengths"))
    # Equal names need the lookup once only.
    distinct = logged.groupBy("_logged").agg(F.min("_record").alias("_record"))
    cut = distinct.withColumn("_lengths", lengths.scalar())
    windows = cut.select(
        "_logged", "_record", F.explode(_windows("_logged", "_lengths")).alias("_part")
    )
    whole_rule = F.expr(f"_logged LIKE concat('%', filename, '%') ESCAPE '{ESCAPE}'")
    return parts.join(windows, "_part").filter(whole_rule)


def longest_part(parts: Column) -> Column:
    """The longest part, the last in order if several are as long; '' if all are empty."""
    longest = F.array_max(
        F.transform(parts, lambda part: F.struct(F.length(part).alias("n"), part.alias("part")))
    )
    return longest["part"]


def _windows(text: str, lengths: str) -> Column:
    """The distinct substrings of these lengths."""
    return F.expr(
        f"""array_distinct(flatten(transform({lengths}, n -> CASE
            WHEN n = 0 THEN array('')
            WHEN n > length({text}) THEN array()
            ELSE transform(sequence(1, length({text}) - n + 1), i -> substring({text}, i, n)) END)))"""
    )

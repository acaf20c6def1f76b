"""The file-name rule of ``file_names`` by an inverted index of the logged names.

Each logged name is stored once for every run of ``GRAM`` characters in it, and once under the empty
text; postings are partitioned by a hash of the run. A new name is looked up by one run of its longest
part without wild cards: the one that fewest logged names hold. Only the partitions of the runs in
question are read, and the whole rule is checked on the names that meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.operators.file_names import find_logged, longest_part
from coinbrook.sinks.scratch import materialize

GRAM = 3
PARTS = 64


def _grams(text: str) -> Column:
    """The distinct runs of ``GRAM`` characters; none of a shorter text."""
    return F.expr(
        f"""array_distinct(CASE WHEN length({text}) < {GRAM} THEN array()
            ELSE transform(sequence(1, length({text}) - {GRAM - 1}), i -> substring({text}, i, {GRAM})) END)"""
    )


def _part(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def postings(log: DataFrame, info: list[str]) -> DataFrame:
    """Index rows of a log: ``gram``, ``filename``, ``record`` (the first of the name by ``info``) and
    ``part``."""
    record = F.struct(*info).alias("record")
    names = log.filter("filename is not null").select("filename", record)
    names = names.groupBy("filename").agg(F.min("record").alias("record"))
    every = F.concat(_grams("filename"), F.array(F.lit("")))
    cut = names.select(F.explode(every).alias("gram"), "filename", "record")
    return cut.withColumn("part", _part("gram"))


def find_indexed(names: DataFrame, index: DataFrame) -> DataFrame:
    """As ``file_names.find_logged`` with ``match="contains"``, from stored postings.

    Runs a job that finds the partitions of the names' runs, at most ``PARTS`` numbers, and one that
    stores the run of each name.
    """
    parts = names.select("filename").distinct().withColumn("_longest", longest_part(F.split("filename", "[_%]")))
    # A part that is too short for a run is looked for in all names.
    runs = F.when(F.length("_longest") < GRAM, F.array(F.lit(""))).otherwise(_grams("_longest"))
    wanted = parts.select("filename", F.explode(runs).alias("gram")).withColumn("part", _part("gram"))
    read = [r["part"] for r in wanted.select("part").distinct().collect()]
    own = index.filter(F.col("part").isin(read)).select("part", "gram", F.col("filename").alias("_logged"), "record")
    held = own.join(wanted.select("part", "gram").distinct(), ["part", "gram"], "left_semi")
    frequency = held.groupBy("part", "gram").agg(F.count("*").alias("_names"))
    counted = wanted.join(frequency, ["part", "gram"], "left")
    rarest = counted.groupBy("filename").agg(
        F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("names"), "gram", "part")).alias("_run")
    )
    # A name that has a run which no logged name holds is in none of them.
    chosen = materialize(rarest.filter("_run.names > 0").select("filename", "_run.gram", "_run.part"), "runs")
    # Names that share a run meet its logged names once, not each of them; of these, the lookup by whole
    # parts finds the pairs.
    meeting = own.join(chosen.select("part", "gram").distinct(), ["part", "gram"], "left_semi")
    logged = meeting.groupBy("_logged").agg(F.min("record").alias("record"))
    first = find_logged(chosen.select("filename"), logged.withColumnRenamed("_logged", "filename"), ["record"])
    first = first.filter("hit is not null").select("filename", F.col("hit.record").alias("hit"))
    keyed = first.withColumn("_hash", F.xxhash64("filename"))
    rows = names.withColumn("_hash", F.xxhash64("filename"))
    return rows.join(keyed, ["filename", "_hash"], "left").drop("_hash")

"""Records of CSV files whose quoted cells may hold line breaks, without reading a file whole.

The CSV reader can split a file only where every line break ends a record. Here the lines are
read as text, in splits, and each line is judged for both cases: it starts outside quotes, or
inside them. Which case holds follows from the lines before it - first within a split, then from
split to split, where only one row per split is left to look at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coinbrook.sinks.scratch import materialize

# A closed field, a quoted field still open where the line ends, and the rest of a cell that a
# line before has opened.
_CLOSED_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+'
_OPEN_FIELD = r'"(?:[^"]++|"")*+'
_REST_OF_CELL = r'(?:[^"]++|"")*+'

# A line that starts outside quotes and ends inside, and one that starts inside and ends inside.
OPENS = rf"(?s)^(?:{_CLOSED_FIELD},)*+{_OPEN_FIELD}\z"
STAYS_OPEN = rf'(?s)^{_REST_OF_CELL}(?:"[^,]*+,(?:{_CLOSED_FIELD},)*+{_OPEN_FIELD})?+\z'


def read_lines(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    """Lines as text with their place: ``file``, ``block`` (start of the split) and ``line``,
    which rises within a block."""
    return (
        spark.read.options(lineSep="\n", **options)
        .text(list(paths))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )


def opens_cell(line: Column) -> Column:
    """Does a line that starts a record leave a cell open?"""
    return line.rlike(OPENS)


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Whole records without the header, as ``file`` and ``record``; blank ones are left out.

    A record whose cell is still open at the end of its file may be most of the file. Its lines are
    not put together; its first line alone stands for it, with ``unclosed`` set.
    """
    within = Window.partitionBy("file", "block").orderBy("line")
    lines = read_lines(spark, paths).withColumns(
        {"_if_closed": opens_cell(F.col("value")), "_if_open": F.col("value").rlike(STAYS_OPEN)}
    )
    # A line either settles the state (same result in both cases), or keeps or flips it.
    lines = _settle(lines, F.col("_if_closed"), F.col("_if_open"), within)
    # How many records begin in the block, in both cases.
    begins = {
        name: ~F.coalesce(F.lag(_resolve(F.lit(start))).over(within), F.lit(start))
        for name, start in (("_if_closed_begin", False), ("_if_open_begin", True))
    }
    blocks = lines.withColumns(begins).groupBy("file", "block").agg(
        F.max_by("_settled", "line").alias("_settled"),
        F.max_by("_flips", "line").alias("_flips"),
        *[F.count_if(F.col(name)).alias(name) for name in begins],
    )
    along = Window.partitionBy("file").orderBy("block")
    cases = blocks.select(
        "file",
        "block",
        _resolve(F.lit(False)).alias("_if_closed"),
        _resolve(F.lit(True)).alias("_if_open"),
        *begins,
    )
    chain = _settle(cases, F.col("_if_closed"), F.col("_if_open"), along)
    chain = chain.withColumn("_ends_open", _resolve(F.lit(False))).withColumn(
        "_start_open", F.coalesce(F.lag("_ends_open").over(along), F.lit(False))
    )
    begun = F.when(F.col("_start_open"), F.col("_if_open_begin")).otherwise(F.col("_if_closed_begin"))
    opening = chain.select("file", "block", "_start_open", "_ends_open", begun.alias("_begun"))
    state = lines.join(opening, ["file", "block"]).withColumn(
        "_open_after", _resolve(F.col("_start_open"))
    )
    state = state.withColumn(
        "_open_before", F.coalesce(F.lag("_open_after").over(within), F.col("_start_open"))
    )
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = state.withColumn("_nth", F.count_if(~F.col("_open_before")).over(upto))
    # Stored, so that the text is scanned twice in all.
    return _assemble(materialize(_pieces(state), "pieces"), along)


def _pieces(state: DataFrame) -> DataFrame:
    """Records that lie in one block, put together where the lines of the block are, so that no text is
    shuffled for it; of those that run over an end of the block (``over``), each line by itself.

    ``line`` is the place of the first line. A line that goes on with a record of an earlier block
    has no ``begins_at``.
    """
    over = (F.col("_nth") == 0) | (F.col("_ends_open") & (F.col("_nth") == F.col("_begun")))
    alone = F.when(over, F.col("line"))
    pieces = state.groupBy("file", "block", "_nth", alone.alias("_alone")).agg(
        F.array_sort(F.collect_list(F.struct("line", "value"))).alias("_lines"),
        F.max("_open_after").alias("_open_after"),
    )
    return pieces.select(
        "file",
        "block",
        F.col("_lines")[0]["line"].alias("line"),
        F.when(F.col("_nth") > 0, F.col("_nth")).alias("nth"),
        F.col("_alone").isNotNull().alias("over"),
        F.col("_open_after").alias("open_after"),
        F.concat_ws("\n", "_lines.value").alias("record"),
    )


def _settle(rows: DataFrame, if_closed: Column, if_open: Column, order: Window) -> DataFrame:
    """Add ``_flips``, the number of state changes so far, and ``_settled``, the last state that
    was settled, with the number of changes by then."""
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flips = rows.withColumn("_flips", F.count_if(if_closed & ~if_open).over(upto))
    settled = F.when(if_closed == if_open, F.struct(if_closed.alias("open"), "_flips"))
    return flips.withColumn("_settled", F.last(settled, ignorenulls=True).over(upto))


def _resolve(start: Column) -> Column:
    """State after a row, if ``start`` is the state before the first."""
    base = F.coalesce(F.col("_settled.open"), start)
    changes = F.col("_flips") - F.coalesce(F.col("_settled._flips"), F.lit(0))
    return base != (changes % 2 == 1)


def _assemble(pieces: DataFrame, along: Window) -> DataFrame:
    """Put the lines together of the records that run over the end of a block; a record is known by
    its block and its number there."""
    lines = pieces.filter("over")
    begin = F.when(F.col("nth").isNotNull(), F.struct("block", "nth"))
    begins = lines.groupBy("file", "block").agg(
        F.max(begin).alias("_last"), F.max_by("open_after", "line").alias("_ends_open")
    )
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # A block that ends open is followed by one that starts within a record, so that the last one here
    # tells how the file ends.
    ends_open = F.max_by("_ends_open", "block").over(whole)
    carried = begins.select(
        "file",
        "block",
        F.last("_last", ignorenulls=True).over(before).alias("_carried"),
        F.when(ends_open, F.max("_last").over(whole)).alias("_tail"),
    )
    lines = lines.join(carried, ["file", "block"]).withColumn("_begin", F.coalesce(begin, "_carried"))
    # From ``_tail`` to the end of the file, one cell is open. ``unclosed`` is no literal: an error
    # that a caller raises by it would be moved below the filter and hit every row.
    in_tail = F.col("_begin").eqNullSafe(F.col("_tail"))
    tails = (
        lines.filter(in_tail)
        .groupBy("file")
        .agg(
            F.min_by("record", F.struct("block", "line")).alias("record"),
            F.max(F.col("_tail").isNotNull()).alias("unclosed"),
        )
    )
    joined = (
        lines.filter(~in_tail)
        .groupBy("file", "_begin")
        .agg(F.array_sort(F.collect_list(F.struct("block", "line", "record"))).alias("_lines"))
        .select(
            "file",
            F.col("_lines")[0]["block"].alias("block"),
            F.col("_lines")[0]["line"].alias("line"),
            F.concat_ws("\n", "_lines.record").alias("record"),
        )
    )
    single = pieces.filter("not over").select("file", "block", "line", "record")
    records = single.unionByName(joined).filter(F.col("record").rlike(r"\S"))
    # One row per file, as many as the listing of the files has.
    header = (
        pieces.filter((F.col("block") == 0) & F.col("record").rlike(r"\S"))
        .groupBy("file", "block")
        .agg(F.min("line").alias("line"))
    )
    closed = records.join(F.broadcast(header), ["file", "block", "line"], "left_anti").select(
        "file", "record", F.lit(False).alias("unclosed")
    )
    return closed.unionByName(tails).withColumn("record", F.rtrim("record", F.lit("\r")))

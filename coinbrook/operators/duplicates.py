"""Duplicate checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.amounts import parse_amount
from coinbrook.functions.dates import parse_date
from coinbrook.operators.grouping import grouped
from coinbrook.operators.lookup import attach, seen_before
from coinbrook.sinks.scratch import materialize

# Rows of one file are duplicates if they agree on these.
FILE_KEY = ["date", "amount", "from_account", "towards"]

# A submission repeats a fact if both agree on these; the description ignores case.
ROW_KEY = ["key_date", "key_description", "key_amount", "key_category", "key_from", "key_towards"]


def file_key(columns: Sequence[str]) -> dict[str, Column]:
    """The key columns that there are. Amounts are compared as numbers: ``1.0`` repeats ``1.00``."""
    return {
        c: parse_amount(F.col(c)) if c == "amount" else F.col(c) for c in FILE_KEY if c in columns
    }


def duplicate_groups(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Groups of more than one row with equal date, amount and accounts, and their size.

    ``within`` names further key columns, such as the file a row came from. The amount of a group
    is a number; rows without one, like rows without another key column, belong to no group.
    """
    keyed = df.select(*within, *[c.alias(n) for n, c in file_key(df.columns).items()])
    counts = grouped(keyed, [*within, *FILE_KEY], F.count("*").alias("occurrence_count"))
    return counts.filter("occurrence_count > 1")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, or are missing."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("row_count"))
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return counts.filter((F.col("row_count") > 1) | missing)


def files_with_bad_ids(rows: DataFrame, files: DataFrame, history: DataFrame) -> DataFrame:
    """Files that bring ids of their own which cannot be keys: missing, repeated in the file, present
    in the history, or used by an earlier file that can be imported. Returns the distinct ``file``.

    ``files`` (``file``, ``arrival``) are those that have passed all other checks. Files are settled
    in rounds, as if imported one after the other: those that come first for each of their ids can
    be imported, later ones with one of these ids cannot. One round is the usual case, as only files
    that share ids with files yet unsettled take a further one.
    """
    own = rows.filter("has_id").select("file", "id").join(files.select("file", "arrival"), "file")
    missing = own.filter("id is null").select("file")
    counted = own.filter("id is not null").groupBy("id", "file").agg(
        F.count("*").alias("_n"), F.min("arrival").alias("_arrival")
    )
    placed = materialize(counted.withColumn("_place", F.struct("_arrival", "file")), "ids")
    repeated = placed.filter("_n > 1").select("file")
    known = seen_before(history.select("id"), placed, ["id"]).distinct()
    used = _with_id(placed, known).select("file")
    bad = materialize(missing.unionByName(repeated).unionByName(used).distinct(), "bad-ids")
    open_ = placed.join(bad, "file", "left_anti")
    while True:
        first = open_.groupBy("id").agg(F.min("_place").alias("_first"))
        marked = attach(open_, first, ["id"])
        late = marked.filter("_place > _first").select("file").distinct()
        if late.isEmpty():
            return bad
        # What is not late is settled; its ids are taken from the others.
        taken = open_.join(late, "file", "left_anti").select("id").distinct()
        waiting = materialize(open_.join(late, "file", "left_semi"), "ids")
        beaten = _with_id(waiting, taken).select("file").distinct()
        bad = materialize(bad.unionByName(beaten).distinct(), "bad-ids")
        open_ = materialize(waiting.join(beaten, "file", "left_anti"), "ids")


def _with_id(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is one of ``ids``; the rows of a hot id are split."""
    return attach(placed, ids.withColumn("_found", F.lit(True)), ["id"]).filter("_found").drop("_found")


def with_submission_key(submissions: DataFrame) -> DataFrame:
    """Add the six key columns to rows with form labels."""
    return submissions.withColumns(
        {
            "key_date": parse_date(F.col("Date")),
            "key_description": F.lower("Description"),
            "key_amount": parse_amount(F.col("Amount")),
            "key_category": F.col("Category"),
            "key_from": F.col("From Account"),
            "key_towards": F.col("To Account"),
        }
    )


def with_fact_key(fact: DataFrame) -> DataFrame:
    """The six key columns of the fact table, and the record a match reports."""
    record = F.struct(
        "id",
        "expense_date",
        "description",
        "expend_amount",
        "parent_category",
        "from_account_marker",
        "towards_category",
    )
    return fact.select(
        F.col("expense_date").alias("key_date"),
        F.lower("description").alias("key_description"),
        F.col("expend_amount").alias("key_amount"),
        F.col("parent_category").alias("key_category"),
        F.col("from_account_marker").alias("key_from"),
        F.col("towards_category").alias("key_towards"),
        record.alias("record"),
    )


def matching_facts(keyed_submissions: DataFrame, fact: DataFrame) -> DataFrame:
    """Per submission key found in the fact table: the matching record with the lowest id."""
    hits = seen_before(with_fact_key(fact), keyed_submissions, ROW_KEY)
    return hits.groupBy(*ROW_KEY).agg(F.min("record").alias("duplicate_of"))


def mark_repeated(submissions: DataFrame, fact: DataFrame) -> DataFrame:
    """Add ``duplicate_of``, the fact a submission repeats, or NULL. A missing key value never
    equals another one."""
    keyed = with_submission_key(submissions)
    return attach(keyed, matching_facts(keyed, fact), ROW_KEY).drop(*ROW_KEY)


def all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present

"""The two gates in front of the ledger: for files, all or nothing; for rows, one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.operators.duplicates import (
    ROW_KEY,
    files_with_bad_ids,
    matching_facts,
    with_submission_key,
)
from coinbrook.operators.file_names import find_logged
from coinbrook.operators.lookup import attach
from coinbrook.operators.name_index import find_indexed
from coinbrook.operators.validation import check_file_rows, structure_errors, validate_rows
from coinbrook.sinks.scratch import materialize

ACCEPTED = "accepted"
BAD_STRUCTURE = "structure"
ALREADY_IMPORTED = "already imported"
DUPLICATE_ROWS = "duplicate rows"
BAD_DATES = "bad dates"
BAD_IDS = "bad ids"
INVALID = "invalid"
DUPLICATE = "duplicate"

#: Columns of the import log, in the order by which the first entry of a name is told.
LOG_ORDER = ["ts", "id", "filename", "date_imported", "no_of_rows_imported"]


def gate_files(
    files: DataFrame,
    rows: DataFrame,
    log: DataFrame,
    match: str = "contains",
    strict: bool = False,
    history: DataFrame | None = None,
    name_index: DataFrame | None = None,
) -> DataFrame:
    """Verdict per file of a batch.

    ``files`` has one row per file: ``file`` (unique), ``filename`` (as logged), ``arrival`` (any
    orderable value) and ``missing_columns``. ``rows`` are the normalised raw rows of all files
    with their ``file``. The first failing check names the status, in this order: structure,
    already imported, duplicate rows, dates, ids. Ids that rows bring along (``has_id``) are
    compared with those of ``history``, if given. Where two files of the batch would block each
    other by name or id, the earlier one wins, as if they had been imported one after the other;
    a file that is rejected blocks no other by its ids. With ``name_index``, the postings of the
    log (see ``operators.name_index``), names are looked up there instead of in the log.

    The verdicts per file are stored on the way, so this runs jobs.
    """
    findings = check_file_rows(rows, ["file"], strict)
    counts = [c for c in findings.columns if c != "file"]
    if name_index is not None and match == "contains":
        logged = find_indexed(files, name_index)
    else:
        logged = find_logged(files, log, LOG_ORDER, match)
    known = (
        logged.withColumnRenamed("hit", "imported_as")
        .join(findings, "file", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn("errors", structure_errors(counts, F.col("missing_columns"), strict))
        .withColumn("status", _status())
    )
    # One row per file, used twice below. Stored, so that the rows of the files are read once.
    known = materialize(known, "files")
    order = F.struct("arrival", "file")
    sound = known.filter(F.col("status") == ACCEPTED).select("filename", order.alias("arrived"))
    earlier = find_logged(files.select("filename").distinct(), sound, ["arrived"], match)
    late = (F.col("status") == ACCEPTED) & (F.col("hit.arrived") < order)
    judged = known.join(earlier, "filename", "left").withColumn(
        "status", F.when(late, ALREADY_IMPORTED).otherwise(F.col("status"))
    )
    if history is not None:
        sound = judged.filter(F.col("status") == ACCEPTED)
        bad = files_with_bad_ids(rows, sound, history).withColumn("_bad", F.lit(True))
        judged = judged.join(bad, "file", "left").withColumn(
            "status", F.when(F.col("_bad"), BAD_IDS).otherwise(F.col("status"))
        )
    return judged.select("file", "filename", "status", *counts, "errors", "imported_as")


def _status() -> Column:
    return (
        F.when(F.size("errors") > 0, BAD_STRUCTURE)
        .when(F.col("imported_as").isNotNull(), ALREADY_IMPORTED)
        .when(F.col("duplicate_groups") > 0, DUPLICATE_ROWS)
        .when(F.col("bad_dates") > 0, BAD_DATES)
        .otherwise(ACCEPTED)
    )


def prepare_rows(submissions: DataFrame) -> DataFrame:
    """Field checks and typed key columns of a batch of submissions.

    A map over the rows, and the costly part of the gate: store the result before it is judged,
    since judging reads it more than once. An invalid row has no like, so its key stays empty.
    """
    checked = with_submission_key(validate_rows(submissions))
    return checked.withColumns({k: F.when(F.col("is_valid"), F.col(k)) for k in ROW_KEY})


def judge_rows(
    prepared: DataFrame,
    fact: DataFrame,
    order: str,
    matches: Callable[[DataFrame, DataFrame], DataFrame] = matching_facts,
) -> DataFrame:
    """Verdict per prepared submission; ``order`` is a unique column giving their order. ``matches``
    looks valid entries up in ``fact``; with ``matching_keys`` that is the key history.

    A submission is ``invalid`` if a field check failed. It is a ``duplicate`` if the fact table
    has its like, or an earlier valid submission of the batch is its like.
    """
    valid = prepared.filter("is_valid")
    # One row per key: copies collapse before they are shuffled.
    first = valid.groupBy(*ROW_KEY).agg(F.min(order).alias("first_order"))
    per_key = first.join(matches(valid, fact), ROW_KEY, "left")
    status = F.when(
        F.col("duplicate_of").isNotNull() | (F.col("first_order") < F.col(order)), DUPLICATE
    ).otherwise(ACCEPTED)
    judged = attach(valid, per_key, ROW_KEY).withColumn("status", status).drop("first_order")
    invalid = prepared.filter("not is_valid").withColumn("status", F.lit(INVALID))
    return judged.unionByName(invalid, allowMissingColumns=True).drop(*ROW_KEY)


def gate_rows(submissions: DataFrame, fact: DataFrame, order: str) -> DataFrame:
    """Verdict per submission of a batch, with the checked batch stored in between."""
    return judge_rows(materialize(prepare_rows(submissions), "submissions"), fact, order)

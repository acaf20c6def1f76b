"""The ledger: imports, entry of rows, refresh of the fact table, export.

One job writes to a ledger at a time. Every import runs under a batch id and can be repeated
under that id after a failure: finished steps are found done, unfinished ones start over, and no
row is added twice.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.operators.duplicates import key_violations
from coinbrook.operators.date_order import DAY_FIRST, date_orders, with_month_first
from coinbrook.operators.gates import ACCEPTED, LOG_ORDER, gate_files, judge_rows, prepare_rows
from coinbrook.operators.id_filter import filter_of, may_be_known
from coinbrook.operators.key_history import keys_of, matching_keys
from coinbrook.operators.lookup import attach, seen_before
from coinbrook.operators.name_index import postings
from coinbrook.operators.normalize import normalize_header, rename_form_labels, to_expenses_line
from coinbrook.operators.quarantine import ERROR_COLUMNS, quarantined
from coinbrook.operators.running_total import ROWS_PER_SPLIT, running_total, sums_of_splits
from coinbrook.operators.validation import missing_columns
from coinbrook.plans import cells
from coinbrook.plans.accounts import accounts_to_add, seed_rows
from coinbrook.plans.fact import build_fact, new_facts
from coinbrook.plans.kpis import AMOUNT, cumulative_trend, filter_expenses
from coinbrook.plans.mart import stored_mart
from coinbrook.schemas import DEFAULT_CATEGORY, DIM_ACCOUNT, EXPENSES_LINE, FRAME_NAME
from coinbrook.sinks.export import export_tables
from coinbrook.sinks.scratch import materialize
from coinbrook.sinks.tables import FORM_FIELDS, KEY_BUCKETS, LedgerTables
from coinbrook.sources.csv_files import CsvFile, file_frame, find_files, read_csv, read_files
from coinbrook.sources.local import local_frame


def _new_batch() -> str:
    return f"{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"


class Ledger:
    """``location`` is the shared folder of the tables; without it the warehouse is used. With
    ``keep_mart`` every import brings the KPI mart up to date from its own rows; batches that came
    in without are caught up with when such a ledger is opened. The same goes for ``keep_indexes``:
    the history by duplicate key, in ``key_buckets`` buckets, and the logged names by runs of
    characters, which the checks of new rows and files then use."""

    def __init__(
        self,
        spark: SparkSession,
        database: str = "ledger",
        location: str | None = None,
        as_of: dt.datetime | None = None,
        keep_mart: bool = False,
        rows_per_split: int = ROWS_PER_SPLIT,
        keep_indexes: bool = False,
        key_buckets: int = KEY_BUCKETS,
    ):
        self.spark = spark
        self.keep_indexes = keep_indexes
        self.as_of = as_of
        self.keep_mart = keep_mart
        self.rows_per_split = rows_per_split
        # Batches landed here that the fact table cannot have seen yet.
        self._fresh: set[str] = set()
        self.tables = LedgerTables(spark, database, location).open()
        self.add_accounts(seed_rows(spark))
        if keep_mart:
            self.tables.open_mart()
            self._count_batches()
        if keep_indexes:
            self.tables.open_indexes(key_buckets)
            self._index_batches()

    # -- reading ---------------------------------------------------------------------------

    # A batch that a job has begun and not ended is seen by no reader: neither its raw rows nor its
    # facts nor its log entries, until a repeat has written all of them.

    def expenses(self) -> DataFrame:
        return self.tables.read("expenses_line", self._open())

    def fact(self) -> DataFrame:
        fact, begun = self.tables.read("fct_expense"), self._open()
        if not begun:
            return fact
        # Only after a failure; facts are known by the ids of the raw rows of the batch.
        lines = [self.tables.read_batch("expenses_line", b).select("id") for b in begun]
        return fact.join(reduce(DataFrame.unionByName, lines).distinct(), "id", "left_anti")

    def accounts(self) -> DataFrame:
        return self.tables.read("dim_account")

    def import_log(self) -> DataFrame:
        return self.tables.read("integrity_file_imported", self._open())

    def _open(self) -> list[str]:
        """Batches that have not ended, from the catalog alone; none unless a job runs or has failed."""
        return sorted(self.tables.batches("open_batch"))

    def _lines(self) -> DataFrame:
        return self.tables.read("expenses_line")

    def _facts(self) -> DataFrame:
        return self.tables.read("fct_expense")

    def _log(self) -> DataFrame:
        return self.tables.read("integrity_file_imported")

    @contextmanager
    def _batch(self, batch_id: str) -> Iterator[None]:
        """Writes in here show up together: readers see them when the mark is taken away, which comes
        last. After a failure the mark stays until a repeat of the batch has ended. The jobs
        themselves check against all rows that are stored, those of open batches included."""
        # One that has ended stays in sight, whatever comes of its repeat.
        if not self.tables.has_batch("expenses_line", batch_id):
            begun = self.spark.range(1).select(F.current_timestamp().alias("begun"))
            self.tables.write_batch("open_batch", begun, batch_id)
        yield
        self.tables.drop_batch("open_batch", batch_id)

    # -- writing ---------------------------------------------------------------------------

    def add_accounts(self, candidates: DataFrame) -> None:
        """Add the accounts whose marker is new."""
        added = accounts_to_add(candidates, self.accounts())
        self.tables.append("dim_account", added, [f.name for f in DIM_ACCOUNT])

    def insert(self, rows: DataFrame, batch_id: str | None = None) -> str:
        """Append rows, and bring the fact table up to date. Only ids that the rows bring along are
        checked: missing, repeated or known ones raise ValueError, and nothing is added."""
        batch_id = batch_id or _new_batch()
        if "id" in rows.columns and not self.tables.has_batch("expenses_line", batch_id):
            self._check_ids(rows)
        with self._batch(batch_id):
            self._land(to_expenses_line(rows), batch_id)
            self.sync_fact(batch_id)
        return batch_id

    def _check_ids(self, rows: DataFrame) -> None:
        ids = rows.select("id")
        if self.keep_indexes:
            # Only the batches that may hold one of the ids are read, one partition each.
            hits = materialize(may_be_known(ids, self.tables.read("id_word")), "id-hits")
            batches = [r["batch_id"] for r in hits.select("batch_id").distinct().collect()]
            stored = self.spark.table(f"{self.tables.database}.expenses_line")
            own = stored.filter(F.col("batch_id").isin(batches)).select("id", "batch_id")
            known = own.join(hits, ["id", "batch_id"], "left_semi")
        else:
            known = seen_before(self._lines().select("id"), ids, ["id"])
        if not key_violations(ids, ["id"]).isEmpty() or not known.isEmpty():
            raise ValueError("the rows bring ids that are missing, repeated or known already")

    def _land(self, lines: DataFrame, batch_id: str) -> None:
        """Write raw rows, unless the batch has landed before."""
        if self.tables.has_batch("expenses_line", batch_id):
            return
        if "source_file" not in lines.columns:
            lines = lines.withColumn("source_file", F.lit(None).cast("string"))
        self.tables.write_batch("expenses_line", lines, batch_id)
        self._fresh.add(batch_id)

    def seed(self, path: str) -> bool:
        """Fill an empty ledger from a CSV file, without checks; True if that was needed.

        A repeat after an interruption adds the facts that are missing."""
        if self.tables.has_batch("expenses_line", "seed"):
            with self._batch("seed"):
                self.sync_fact("seed")
            return False
        if not self._lines().isEmpty():
            return False
        rows = read_csv(self.spark, path)
        if "id" in rows.columns:
            # Parsed once, for the check of the ids and the rows that land.
            rows = materialize(to_expenses_line(rows), "seed")
        self.insert(rows, "seed")
        return True

    def refresh_fact(self) -> None:
        """Rebuild the whole fact table; all clock columns are stamped anew."""
        self._fresh.clear()
        self.tables.swap_fact(build_fact(self._lines(), self.as_of))

    def refresh_mart(self) -> DataFrame:
        """Compute all KPIs from the fact table and store them; readers see the old ones until the
        new ones are complete. Returns the mart, see ``plans.mart.read_kpi``."""
        self.tables.swap_mart(stored_mart(self.fact()))
        return self.mart()

    def mart(self) -> DataFrame:
        return self.spark.table(f"{self.tables.database}.kpi_mart")

    def sync_fact(self, batch_id: str | None = None) -> None:
        """Add the fact rows that are missing - of one batch, or of all.

        Rows this object has just landed cannot be in the fact table yet and are added unseen.
        Only for a batch that had landed before, say in a job that died, the ids are compared.
        """
        if batch_id in self._fresh:
            lines = self.tables.read_batch("expenses_line", batch_id)
            self._fresh.discard(batch_id)
            self.tables.add_facts(build_fact(lines, self.as_of))
        elif batch_id is None:
            missing = new_facts(self._lines(), self._facts(), self.as_of, small_batch=False)
            self.tables.add_facts(missing)
        else:
            lines = self.tables.read_batch("expenses_line", batch_id)
            missing = new_facts(lines, self._facts(), self.as_of)
            self.tables.add_facts(missing)
        if self.keep_mart:
            if batch_id is None:
                self._count_batches()
            else:
                self._count_batch(batch_id)
        if self.keep_indexes:
            if batch_id is None:
                self._index_batches()
            else:
                self._index_keys(batch_id)

    # -- indexes for the checks against history ----------------------------------------------

    def _index_keys(self, batch_id: str) -> None:
        if not self.tables.has_batch("fact_key", batch_id):
            lines = self.tables.read_batch("expenses_line", batch_id)
            self.tables.write_batch("id_word", filter_of(lines), batch_id)
            keys = keys_of(self._batch_facts(batch_id), self.tables.buckets("fact_key"))
            self.tables.write_batch("fact_key", keys, batch_id)

    def _index_names(self, batch_id: str) -> None:
        if not self.tables.has_batch("log_gram", batch_id):
            log = self.tables.read_batch("integrity_file_imported", batch_id)
            self.tables.write_batch("log_gram", postings(log, LOG_ORDER), batch_id)

    def _index_batches(self) -> None:
        """Index the batches that came in without."""
        for batch_id in sorted(self.tables.batches("expenses_line") - self.tables.batches("fact_key")):
            self._index_keys(batch_id)
        for batch_id in sorted(self.tables.batches("integrity_file_imported") - self.tables.batches("log_gram")):
            self._index_names(batch_id)

    def _name_index(self) -> DataFrame | None:
        return self.tables.read("log_gram") if self.keep_indexes else None

    # -- the maintained mart -----------------------------------------------------------------

    def _count_batch(self, batch_id: str) -> None:
        """Store the cells of a batch whose facts are in, from its own rows. Its marker comes last;
        until then no reader sees the cells, and a repeat starts over."""
        if self.tables.has_batch("mart_batch", batch_id):
            return
        fact = self._batch_facts(batch_id)
        self.tables.write_batch("mart_cell", cells.mart_cells(fact), batch_id)
        self.tables.write_batch("mart_top", cells.top_of_years(fact), batch_id)
        own = self.tables.read_batch("mart_cell", batch_id).filter("kpi = 'day'")
        self._split_busy_days(own, batch_id)
        counted = own.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("counted_rows"))
        self.tables.write_batch("mart_batch", counted, batch_id)

    def _batch_facts(self, batch_id: str) -> DataFrame:
        return build_fact(self.tables.read_batch("expenses_line", batch_id), self.as_of)

    def _split_busy_days(self, own: DataFrame, batch_id: str) -> None:
        """Sums of the splits of the busy days that a batch touches: the only case in which facts of
        other batches are read, those of these days."""
        touched = own.select(F.col("expense_date").alias("touched")).distinct()
        columns = ["kpi", "expense_date", "rows"]
        days = self._cells().select(*columns).unionByName(own.select(*columns))
        busy = cells.busy_days(days, self.rows_per_split)
        busy = busy.join(touched, F.col("day").eqNullSafe(F.col("touched")), "left_semi").collect()
        if not busy:
            return
        named = [(r["day"], r["day_rows"], r["splits"]) for r in busy]
        days = local_frame(self.spark, named, "day date, day_rows bigint, splits int")
        dated = [r["day"] for r in busy if r["day"] is not None]
        facts = self._facts().select("expense_date", "year", "id", AMOUNT)
        here = F.col("expense_date").isin(dated) & F.col("year").isin(sorted({d.year for d in dated}))
        if len(dated) < len(busy):
            here = here | F.col("expense_date").isNull()
        split_days = days.select(F.col("day").alias("_day"), F.col("splits").alias("_splits"))
        sums = sums_of_splits(facts.filter(here), "expense_date", "id", AMOUNT, split_days)
        rows = sums.join(days, F.col("_day").eqNullSafe(F.col("day"))).select(
            "day",
            "day_rows",
            "splits",
            F.col("_split").alias("split"),
            F.col("units").cast("decimal(38,0)").alias("units"),
            "beyond",
        )
        self.tables.write_batch("day_split", rows, batch_id)

    def _count_batches(self) -> None:
        """Count the landed batches that are not in the mart yet, one after the other."""
        for batch_id in sorted(self.tables.batches("expenses_line") - self.tables.batches("mart_batch")):
            self._count_batch(batch_id)

    def _active(self) -> DataFrame:
        """Batches whose cells count: the counted ones, merged ones in place of their members."""
        merges = self.tables.read("mart_merge")
        every = self.tables.read("mart_batch").select("batch_id").unionByName(merges.select("batch_id").distinct())
        return every.join(merges.select(F.col("member").alias("batch_id")), "batch_id", "left_anti")

    def _cells(self) -> DataFrame:
        return self.tables.read("mart_cell").join(F.broadcast(self._active()), "batch_id", "left_semi")

    def _top(self) -> DataFrame:
        return self.tables.read("mart_top").join(F.broadcast(self._active()), "batch_id", "left_semi")

    def merge_mart(self) -> str:
        """Put one merged batch of cells in place of all that there are, for fewer files to read.
        Readers change over when the list of its members is written, which comes last. Cells that an
        earlier merge replaced are dropped. Returns the id of the merged batch."""
        replaced = [r["member"] for r in self.tables.read("mart_merge").select("member").collect()]
        members = self._active().select(F.col("batch_id").alias("member")).collect()
        merged = f"merged-{_new_batch()}"
        # A table is not written from what is read of it.
        sums = materialize(cells.merged_cells(self._cells()), "merged-cells")
        top = materialize(cells.top_of_years(self._top()), "merged-top")
        self.tables.write_batch("mart_cell", sums, merged)
        self.tables.write_batch("mart_top", top, merged)
        names = local_frame(self.spark, [(r["member"],) for r in members], "member string")
        self.tables.write_batch("mart_merge", names, merged)
        for batch_id in replaced:
            self.tables.drop_batch("mart_cell", batch_id)
            self.tables.drop_batch("mart_top", batch_id)
        return merged

    def kept_mart(self, years: Sequence[int] | None = None) -> DataFrame:
        """The KPIs as ``plans.mart.read_kpi`` reads them, merged from the cells that the imports
        stored; the fact table is not read. With ``years``, over the expenses of these years, and no
        other year's cells are read."""
        seen = ~F.col("batch_id").isin(self._open())
        own, top = self._cells().filter(seen), self._top().filter(seen)
        if years is not None:
            own, top = own.filter(F.col("year").isin(list(years))), top.filter(F.col("year").isin(list(years)))
        return cells.mart_of(own, top, self.accounts())

    def cumulative(self, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
        """KPI 10, one row per expense in date order, from stored totals of the days: only the facts
        from ``start`` to ``end`` are read, and their total still counts all that came before. While
        a batch is open, its part in the stored totals is not told apart, and all facts are read."""
        if self._open():
            return filter_expenses(cumulative_trend(self.fact()), filter_start_date=start, filter_end_date=end)
        rows = filter_expenses(self.fact(), filter_start_date=start, filter_end_date=end)
        starts = cells.running_starts(self._cells(), self.tables.read("day_split"))
        total = running_total(
            rows.select("expense_date", "id", AMOUNT), "expense_date", "id", AMOUNT, "cumulative_amount", starts=starts
        )
        return total.select("expense_date", "cumulative_amount")

    def import_files(
        self,
        paths: Sequence[str],
        batch_id: str | None = None,
        match: str = "contains",
        strict: bool = False,
        check_line_breaks: bool = True,
    ) -> DataFrame:
        """Import CSV files or directories of them; returns the report, one row per file.

        A file is imported as a whole or not at all, see ``gate_files``. Whether its dates have the
        day or the month first is told from all of them, see ``operators.date_order``. The files are
        stored with the batch, and a repeat under its id must find the same ones: with others, or with
        some that are missing or changed since, it raises ValueError.
        """
        batch_id = batch_id or _new_batch()
        found = find_files(self.spark, paths, check_line_breaks=check_line_breaks)
        self._hold_files(found, batch_id)
        with self._batch(batch_id):
            return self._import(found, batch_id, match, strict)

    def _import(self, found: Sequence[CsvFile], batch_id: str, match: str, strict: bool) -> DataFrame:
        done = all(self.tables.has_batch(t, batch_id) for t in ("file_report", "expenses_line", "quarantine"))
        # Parsed once, for the checks, the rows that land and those that are turned away.
        rows = orders = None
        if not done:
            rows, orders = self._in_order(materialize(read_files(self.spark, found), "parsed"))
        if not self.tables.has_batch("file_report", batch_id):
            files = file_frame(self.spark, found)
            history = self._lines() if any("id" in f.columns for f in found) else None
            verdict = gate_files(
                files, rows, self._log(), match, strict, history, self._name_index()
            )
            self._report_files(verdict, orders, batch_id)
        report = self.tables.read_batch("file_report", batch_id)
        accepted = report.filter(F.col("status") == ACCEPTED)
        if rows is not None:
            self._hold_back(rows, report, batch_id, strict)
            self._land_files(rows, accepted, batch_id)
        if not self.tables.has_batch("integrity_file_imported", batch_id):
            self._log_files(accepted, batch_id)
        self.sync_fact(batch_id)
        return report

    def _in_order(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows with dates that all steps read alike, and the order of day and month by file."""
        if "date" not in rows.columns:
            return rows, None
        orders = materialize(date_orders(rows), "date-orders")
        if orders.filter(F.col("date_order") == DAY_FIRST).isEmpty():
            return rows, orders
        return materialize(with_month_first(rows, orders), "dated"), orders

    def _report_files(self, verdict: DataFrame, orders: DataFrame | None, batch_id: str) -> None:
        report = verdict.withColumn("imported_as", F.col("imported_as.filename"))
        if orders is None:
            report = report.withColumn("date_order", F.lit(None).cast("string"))
        else:
            report = report.join(orders.select("file", "date_order"), "file", "left")
        self.tables.write_batch("file_report", report, batch_id)

    def quarantine(self) -> DataFrame:
        """Rows of rejected files as text, with ``error_field``, ``error_reason``, ``error_value``."""
        return self.tables.read("quarantine")

    def _hold_back(self, rows: DataFrame, report: DataFrame, batch_id: str, strict: bool) -> None:
        """Keep the rows of rejected files, with what is wrong with them."""
        if self.tables.has_batch("quarantine", batch_id):
            return
        columns = [f.name for f in EXPENSES_LINE]
        lacking = {c: F.lit(None).cast("string") for c in [*columns, "extra_fields"] if c not in rows.columns}
        held = quarantined(rows.withColumns(lacking), report, ACCEPTED, strict)
        text = [F.col(c).cast("string").alias(c) for c in columns]
        kept = held.select("file", *text, "extra_fields", "status", *ERROR_COLUMNS)
        self.tables.write_batch("quarantine", kept, batch_id)

    def _hold_files(self, found: Sequence[CsvFile], batch_id: str) -> None:
        """Store the files of a new batch; of a known one, compare them with those stored."""
        own = local_frame(
            self.spark, [(f.file, f.arrival) for f in found], "file string, arrival bigint"
        )
        if not self.tables.has_batch("batch_file", batch_id):
            self.tables.write_batch("batch_file", own, batch_id)
            return
        held = self.tables.read_batch("batch_file", batch_id).select("file", "arrival")
        differing = own.exceptAll(held).unionByName(held.exceptAll(own)).limit(5).collect()
        if differing:
            names = ", ".join(sorted({row["file"] for row in differing}))
            raise ValueError(f"batch {batch_id!r} was begun with other files; differing: {names}")

    def import_frame(
        self,
        rows: DataFrame,
        filename: str = FRAME_NAME,
        batch_id: str | None = None,
        match: str = "contains",
        strict: bool = False,
    ) -> DataFrame:
        """Import a frame under the checks for a file of that name, that of its ids included.

        A repeat under the id of a batch with another name raises ValueError."""
        batch_id = batch_id or _new_batch()
        with self._batch(batch_id):
            return self._import_frame(rows, filename, batch_id, match, strict)

    def _import_frame(
        self, rows: DataFrame, filename: str, batch_id: str, match: str, strict: bool
    ) -> DataFrame:
        rows = normalize_header(rename_form_labels(rows))
        missing = missing_columns(rows.columns)
        has_id = "id" in rows.columns
        rows = rows.withColumns({"file": F.lit(filename), "has_id": F.lit(has_id)})
        rows, orders = self._in_order(rows)
        held = local_frame(self.spark, [(filename, None)], "file string, arrival bigint")
        if not self.tables.has_batch("batch_file", batch_id):
            self.tables.write_batch("batch_file", held, batch_id)
        elif self.tables.read_batch("batch_file", batch_id).first()["file"] != filename:
            raise ValueError(f"batch {batch_id!r} was begun with another file than {filename!r}")
        if not self.tables.has_batch("file_report", batch_id):
            files = local_frame(
                self.spark,
                [(filename, filename, 0, missing)],
                "file string, filename string, arrival int, missing_columns array<string>",
            )
            history = self._lines() if has_id else None
            verdict = gate_files(
                files, rows, self._log(), match, strict, history, self._name_index()
            )
            self._report_files(verdict, orders, batch_id)
        report = self.tables.read_batch("file_report", batch_id)
        accepted = report.filter(F.col("status") == ACCEPTED)
        self._hold_back(rows, report, batch_id, strict)
        if not accepted.isEmpty():
            lines = to_expenses_line(rows).withColumn("source_file", F.lit(filename))
            self._land(lines, batch_id)
            if not self.tables.has_batch("integrity_file_imported", batch_id):
                self._log_files(accepted, batch_id)
            self.sync_fact(batch_id)
        return report

    def _land_files(self, rows: DataFrame, accepted: DataFrame, batch_id: str) -> None:
        passed = accepted.select("file", F.lit(True).alias("_passed"))
        own = attach(rows, passed, ["file"]).filter("_passed").withColumns(
            {
                "id": F.when(F.col("has_id"), F.col("id")).otherwise(F.expr("uuid()")),
                "category": F.when(F.col("has_category"), F.col("category")).otherwise(
                    DEFAULT_CATEGORY
                ),
            }
        )
        lines = to_expenses_line(own, keep=["file"]).withColumnRenamed("file", "source_file")
        self._land(lines, batch_id)

    def _log_files(self, accepted: DataFrame, batch_id: str) -> None:
        now = F.current_timestamp() if self.as_of is None else F.lit(self.as_of).cast("timestamp")
        log = accepted.select(
            F.expr("uuid()").alias("id"),
            now.alias("ts"),
            "filename",
            F.date_format(now, "yyyy-MM-dd").alias("date_imported"),
            # The column is an int; a count beyond it must not fail a batch that has landed.
            F.least(F.col("row_count"), F.lit(2**31 - 1)).cast("int").alias("no_of_rows_imported"),
        )
        self.tables.write_batch("integrity_file_imported", log, batch_id)
        if self.keep_indexes:
            self._index_names(batch_id)

    def submit_rows(self, submissions: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Enter rows from the form; returns the report, one row per submission.

        The rows are stored first, checked, with an id and a running number each, so that every
        later step and every repeat of the batch sees the same ids in the same order. The order is
        that of the frame, or of its column ``entry`` if it has one.
        """
        batch_id = batch_id or _new_batch()
        stored = {f: f.replace(" ", "_") for f in FORM_FIELDS}
        if not self.tables.has_batch("submission", batch_id):
            have = submissions.columns
            entry = F.col("entry") if "entry" in have else F.monotonically_increasing_id()
            fields = [
                (F.col(f) if f in have else F.lit(None)).cast("string").alias(f)
                for f in FORM_FIELDS
            ]
            numbered = submissions.select(
                F.expr("uuid()").alias("submission_id"), entry.cast("bigint").alias("entry"), *fields
            )
            staged = prepare_rows(numbered).withColumnsRenamed(stored)
            self.tables.write_batch("submission", staged, batch_id)
        if not self.tables.has_batch("submission_report", batch_id):
            staged = self.tables.read_batch("submission", batch_id)
            staged = staged.withColumn("_order", F.struct("entry", "submission_id"))
            if self.keep_indexes:
                verdict = judge_rows(staged, self.tables.read("fact_key"), "_order", matching_keys)
            else:
                verdict = judge_rows(staged, self._facts(), "_order")
            report = verdict.withColumn("duplicate_of", F.col("duplicate_of.id"))
            self.tables.write_batch("submission_report", report, batch_id)
        report = self.tables.read_batch("submission_report", batch_id)
        passed = report.filter(F.col("status") == ACCEPTED)
        rows = passed.withColumnsRenamed({s: f for f, s in stored.items()})
        rows = rows.select(F.col("submission_id").alias("id"), *FORM_FIELDS)
        with self._batch(batch_id):
            self._land(to_expenses_line(rows), batch_id)
            self.sync_fact(batch_id)
        return report

    def export(self, directory: str, format: str = "csv") -> dict[str, str]:
        """Write the user tables to CSV or Parquet; returns the path of each."""
        shown = {
            "expenses_line": self.expenses,
            "fct_expense": self.fact,
            "integrity_file_imported": self.import_log,
        }
        tables = {n: shown[n]() if n in shown else self.tables.read(n) for n in self.tables.names()}
        return export_tables(tables, directory, format, self.as_of)

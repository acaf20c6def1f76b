"""One query per operator, on the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.checks import adapters as a
from coinbrook.functions.amounts import coerce_amount
from coinbrook.functions.dates import calendar_columns, parse_date, parse_iso_date, season
from coinbrook.operators import normalize
from coinbrook.operators.date_order import date_orders, with_month_first
from coinbrook.operators.duplicates import (
    ROW_KEY,
    duplicate_groups,
    key_violations,
    mark_repeated,
    with_submission_key,
)
from coinbrook.operators.file_names import find_logged
from coinbrook.operators.gates import ACCEPTED, gate_files, gate_rows
from coinbrook.operators.key_history import matching_keys
from coinbrook.operators.lookup import attach
from coinbrook.operators.name_index import find_indexed
from coinbrook.operators.quarantine import quarantined
from coinbrook.operators.validation import check_file_rows, null_columns, validate_file, validate_rows
from coinbrook.plans import kpis
from coinbrook.plans.accounts import accounts_to_add, seed_rows
from coinbrook.plans.fact import build_fact, new_facts
from coinbrook.plans.ledger import Ledger
from coinbrook.plans.mart import KPI_KEYS, kpi_mart, read_kpi
from coinbrook.session import tune
from coinbrook.sinks.scratch import materialize, scratch_path
from coinbrook.streaming import live_kpis
from coinbrook.streaming.continuous import import_stream

Query = Callable[[SparkSession, str], DataFrame]


def _orders_fact(spark: SparkSession, sf: str) -> DataFrame:
    return build_fact(a.order_expenses(spark, sf), a.AS_OF)


def _items_fact(spark: SparkSession, sf: str) -> DataFrame:
    return build_fact(a.item_expenses(spark, sf), a.AS_OF)


def _tagged_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table never has tags of its own; here the account serves as one."""
    tag = F.when(F.col("towards_category") != "t1", F.col("from_account_marker"))
    return _orders_fact(spark, sf).withColumn("category_tag", tag)


# -- fact table ----------------------------------------------------------------------------


def scan_fact(spark: SparkSession, sf: str) -> DataFrame:
    return _items_fact(spark, sf).drop("booked_date", "last_modified_at")


def fct_expense(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_fact(spark, sf).drop("last_modified_at")


def fct_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are in the fact table; the raw table has the events as well."""
    known = _orders_fact(spark, sf)
    lines = a.order_expenses(spark, sf).unionByName(a.event_expenses(spark, sf))
    return new_facts(lines, known, a.AS_OF, small_batch=False).drop("last_modified_at")


def append_bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a raw table, then its totals."""
    path = scratch_path(spark, "append")
    for lines in (a.order_expenses(spark, sf), a.event_expenses(spark, sf)):
        normalize.to_expenses_line(lines).write.mode("append").parquet(path)
    return (
        spark.read.parquet(path)
        .groupBy("towards")
        .agg(F.count("*").alias("row_count"), F.count("date").alias("dated_rows"))
    )


def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = calendar_columns("date")
    del parts["season"]
    return a.order_expenses(spark, sf).select("id", *[c.alias(n) for n, c in parts.items()])


def season_label(spark: SparkSession, sf: str) -> DataFrame:
    return a.order_expenses(spark, sf).select("id", season("date").alias("season"))


# -- input columns -------------------------------------------------------------------------


def normalize_header(spark: SparkSession, sf: str) -> DataFrame:
    raw = a.event_expenses(spark, sf).withColumnsRenamed(
        {"date": "Date", "from_account": "From Account", "towards": "To Account"}
    )
    return normalize.normalize_header(raw)


def default_category(spark: SparkSession, sf: str) -> DataFrame:
    with_column = normalize.default_category(a.order_expenses(spark, sf))
    without = normalize.default_category(a.event_expenses(spark, sf).drop("category"))
    return with_column.unionByName(without).select("id", "category")


def coerced_amount(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.submissions(spark, sf)
    return rows.select("entry", coerce_amount(F.col("Amount")).alias("amount"))


def parsed_date(spark: SparkSession, sf: str) -> DataFrame:
    return a.submissions(spark, sf).select("entry", parse_date(F.col("Date")).alias("date"))


# -- validation ----------------------------------------------------------------------------


def checked_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate_rows(a.submissions(spark, sf)).select(
        "entry",
        "is_valid",
        F.concat_ws(", ", "missing_fields").alias("missing_fields"),
        "error_field",
        "error_reason",
        "error_value",
    )


def validate_file_nulls(spark: SparkSession, sf: str) -> DataFrame:
    findings = check_file_rows(a.file_rows(spark, sf), ["file"])
    return findings.select(
        "file",
        "row_count",
        F.col("null_description").alias("null_descriptions"),
        F.concat_ws(", ", null_columns(findings.columns)).alias("null_columns"),
    )


def validate_file_nonnumeric(spark: SparkSession, sf: str) -> DataFrame:
    """All files as one."""
    report = validate_file(a.file_rows(spark, sf).drop("file"))
    return report.select("is_valid", "row_count", "non_numeric_amounts")


def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(a.file_rows(spark, sf), ["file"])


def dup_vs_fact(spark: SparkSession, sf: str) -> DataFrame:
    fact = build_fact(a.event_expenses(spark, sf), a.AS_OF)
    entered = materialize(a.submissions(spark, sf), "entered")
    marked = mark_repeated(entered, fact)
    return marked.select("entry", F.col("duplicate_of.id").alias("duplicate_of"))


def file_already_imported(spark: SparkSession, sf: str) -> DataFrame:
    names = a.batch_files(spark, sf).select("filename")
    hits = find_logged(names, a.import_log(spark, sf), ["id", "filename"])
    return hits.select("filename", F.col("hit.id").alias("log_id"))


def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return key_violations(a.item_expenses(spark, sf), ["id"])


def _file_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return gate_files(a.batch_files(spark, sf), a.file_rows(spark, sf), a.import_log(spark, sf))


def file_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _file_verdicts(spark, sf).select(
        "filename",
        "status",
        "row_count",
        "duplicate_groups",
        "non_numeric_amounts",
        "bad_dates",
        F.concat_ws("; ", "errors").alias("errors"),
        F.col("imported_as.filename").alias("imported_as"),
    )


def file_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of rejected files, each with the first check that it fails."""
    verdicts = _file_verdicts(spark, sf).withColumn("imported_as", F.col("imported_as.filename"))
    return quarantined(a.file_rows(spark, sf), verdicts, ACCEPTED)


def date_order(spark: SparkSession, sf: str) -> DataFrame:
    """For each file, whether the day or the month comes first in its dates."""
    return date_orders(a.dated_rows(spark, sf))


def dates_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every date as its file has it, and as it is read."""
    rows = a.dated_rows(spark, sf)
    orders = materialize(date_orders(rows), "orders")
    turned = with_month_first(rows.withColumn("written", F.col("date")), orders)
    return turned.select("file", "entry", "written", parse_date(F.col("date")).alias("date"))


def import_log(spark: SparkSession, sf: str) -> DataFrame:
    accepted = _file_verdicts(spark, sf).filter(F.col("status") == ACCEPTED)
    return accepted.select(
        "filename",
        F.lit(f"{a.AS_OF:%Y-%m-%d}").alias("date_imported"),
        F.col("row_count").cast("int").alias("no_of_rows_imported"),
    )


def row_gate(spark: SparkSession, sf: str) -> DataFrame:
    fact = build_fact(a.event_expenses(spark, sf), a.AS_OF)
    verdict = gate_rows(a.submissions(spark, sf), fact, "entry")
    return verdict.select(
        "entry", "status", "error_field", F.col("duplicate_of.id").alias("duplicate_of")
    )


def form_labels(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.rename_form_labels(a.submissions(spark, sf))


def iso_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.submissions(spark, sf)
    return rows.select("entry", parse_iso_date(F.col("Date")).alias("date"))


def file_logged_exact(spark: SparkSession, sf: str) -> DataFrame:
    user = a.table(spark, sf, "events").select("user_id").distinct()
    names = user.select(F.concat(F.lit("menu_"), F.col("user_id").cast("string"), F.lit(".csv")).alias("filename"))
    hits = find_logged(names, a.import_log(spark, sf), ["id", "filename"], match="exact")
    return hits.select("filename", F.col("hit.id").alias("log_id"))


# -- a stored ledger -----------------------------------------------------------------------


def _new_ledger(spark: SparkSession) -> Ledger:
    """A ledger of its own below the shared folder."""
    return Ledger(spark, f"check_{uuid.uuid4().hex}", scratch_path(spark, "ledger"), a.AS_OF)


def ledger_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Two inserts into the raw table, every cell of it."""
    ledger = _new_ledger(spark)
    ledger.insert(a.order_expenses(spark, sf), "orders")
    ledger.insert(a.event_expenses(spark, sf), "events")
    return ledger.expenses()


def ledger_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The stored fact table after two inserts, each adding its facts, and a repeat of one."""
    ledger = _new_ledger(spark)
    ledger.insert(a.order_expenses(spark, sf), "orders")
    ledger.insert(a.event_expenses(spark, sf), "events")
    ledger.insert(a.event_expenses(spark, sf), "events")
    return ledger.fact().drop("last_modified_at")


def _order_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under the labels of a file, with quotes and line breaks in a cell."""
    return a.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("date").alias("Date"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('", or\nnot')).alias("Description"),
        F.col("o_totalprice").alias("Amount"),
        F.col("o_orderstatus").alias("From Account"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("To Account"),
    )


def _order_files(spark: SparkSession, sf: str) -> str:
    """The same, written as CSV files."""
    path = scratch_path(spark, "landing")
    _order_entries(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return path


def ledger_import(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV files and imported as such: the raw rows that arrive."""
    ledger = _new_ledger(spark)
    ledger.import_files([_order_files(spark, sf)], "orders")
    return ledger.expenses()


def ledger_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Orders imported as a frame under the checks for a file."""
    ledger = _new_ledger(spark)
    ledger.import_frame(_order_entries(spark, sf).withColumn("Date", F.col("Date").cast("string")), "orders.csv")
    return ledger.expenses()


def ledger_seed(spark: SparkSession, sf: str) -> DataFrame:
    """An empty ledger filled from CSV files; a second seed adds nothing."""
    ledger = _new_ledger(spark)
    path = _order_files(spark, sf)
    ledger.seed(path)
    ledger.seed(path)
    return ledger.expenses()


def ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The CSV files imported by a stream over their folder, which is run twice."""
    ledger, path, checkpoint = _new_ledger(spark), _order_files(spark, sf), scratch_path(spark, "stream")
    for _ in range(2):
        import_stream(ledger, path, checkpoint, files_per_batch=4).awaitTermination()
    return ledger.expenses()


def ledger_submit(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the form submitted to a ledger that holds the events: the report."""
    ledger = _new_ledger(spark)
    ledger.insert(a.event_expenses(spark, sf), "events")
    report = ledger.submit_rows(a.submissions(spark, sf), "entries")
    return report.select("entry", "status", "error_field", "duplicate_of")


def ledger_submitted(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows that come of the accepted entries; each has an id of its own."""
    ledger = _new_ledger(spark)
    ledger.submit_rows(a.submissions(spark, sf), "entries")
    rows = ledger.expenses()
    ids = rows.groupBy("id").count().filter("count > 1 or id is null")
    return rows.join(ids.select("id"), "id", "left_anti").drop("id")


def ledger_export(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and sums of the exported tables, read back from both formats, by the name of the export."""
    ledger = _new_ledger(spark)
    ledger.insert(a.order_expenses(spark, sf), "orders")
    found = None
    for kind in ("csv", "parquet"):
        for path in ledger.export(scratch_path(spark, "export"), kind).values():
            read = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
            rows = read.agg(
                F.lit(path.rsplit("/", 1)[-1]).alias("export"),
                F.count("*").alias("row_count"),
                F.count_if(F.col(read.columns[0]).isNotNull()).alias("ids"),
            )
            found = rows if found is None else found.unionByName(rows)
    return found


def ledger_log(spark: SparkSession, sf: str) -> DataFrame:
    """The stored import log of the accepted files."""
    ledger = _new_ledger(spark)
    accepted = _file_verdicts(spark, sf).filter(F.col("status") == ACCEPTED)
    ledger._log_files(accepted, "files")
    return ledger.import_log().drop("id", "ts")


def _kept(spark: SparkSession, **options) -> Ledger:
    name = f"check_{uuid.uuid4().hex}"
    return Ledger(spark, name, scratch_path(spark, "ledger"), a.AS_OF, **options)


def _three_imports(spark: SparkSession, sf: str) -> Ledger:
    """A ledger that keeps its mart, after three imports; the dates of the last lie before others."""
    ledger = _kept(spark, keep_mart=True)
    orders = a.order_expenses(spark, sf)
    early = F.coalesce(F.col("date") < "1998-01-01", F.lit(False))
    ledger.insert(orders.filter(~early), "late-orders")
    ledger.insert(a.event_expenses(spark, sf), "events")
    ledger.insert(orders.filter(early), "early-orders")
    return ledger


def mart_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The grouped KPIs of the maintained mart after three imports, the first two of them merged."""
    ledger = _three_imports(spark, sf)
    ledger.merge_mart()
    kpi = ledger.kept_mart().filter(F.col("kpi").isin(list(KPI_KEYS)))
    keys = [key for group in KPI_KEYS.values() for key in group]
    return kpi.select("kpi", *keys, "total", "mean", "transactions")


def mart_kept_others(spark: SparkSession, sf: str) -> DataFrame:
    """Headline, highest expenses, running total by day and balances of the maintained mart."""
    mart = _three_imports(spark, sf).kept_mart().filter(~F.col("kpi").isin(list(KPI_KEYS)))
    columns = ["expense_date", "description", "parent_category", "total", "transactions", "name", "type", "current_balance"]
    return mart.select("kpi", *columns)


def mart_of_years(spark: SparkSession, sf: str) -> DataFrame:
    """The maintained mart of some years: cells of no other year are read."""
    mart = _three_imports(spark, sf).kept_mart([1996, 1999, 2024])
    return read_kpi(mart, "category").select("parent_category", "total", "transactions")


def cumulative_after_late_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The running total from stored totals of days, after a batch with early dates came last."""
    return _three_imports(spark, sf).cumulative()


def kpi_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Live KPIs of a stream that ran over what had landed, stopped, and went on after more landed."""
    ledger = _new_ledger(spark)
    checkpoint = scratch_path(spark, "stream")
    for lines, name in ((a.order_expenses(spark, sf), "orders"), (a.event_expenses(spark, sf), "events")):
        ledger.insert(lines, name)
        live_kpis.kpi_stream(ledger, checkpoint, files_per_batch=2).awaitTermination()
    live = spark.table(f"{ledger.tables.database}.live_kpi")
    return live.select("kpi", *live_kpis.LIVE_KEYS, "total", "transactions")


def dup_vs_fact_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The duplicate lookup of ``dup_vs_fact`` in the bucketed history of a ledger."""
    ledger = _kept(spark, keep_indexes=True)
    ledger.insert(a.event_expenses(spark, sf), "events")
    entered = with_submission_key(materialize(a.submissions(spark, sf), "entered"))
    found = attach(entered, matching_keys(entered, ledger.tables.read("fact_key")), ROW_KEY)
    return found.select("entry", F.col("duplicate_of.id").alias("duplicate_of"))


def file_imported_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The name lookup of ``file_already_imported`` in the stored postings of a ledger's log."""
    ledger = _kept(spark, keep_indexes=True)
    ledger.tables.write_batch("integrity_file_imported", a.import_log(spark, sf), "log")
    ledger._index_names("log")
    hits = find_indexed(a.batch_files(spark, sf).select("filename"), ledger.tables.read("log_gram"))
    return hits.select("filename", F.col("hit.id").alias("log_id"))


# -- accounts ------------------------------------------------------------------------------


def seed_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed accounts and the suppliers, as far as the customers do not have their marker."""
    candidates = a.account_candidates(spark, sf).unionByName(
        seed_rows(spark).withColumn("id", F.col("marker"))
    )
    return accounts_to_add(candidates, a.accounts(spark, sf))


def accounts_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates many of which share a marker, or have none."""
    n = F.substring("id", 2, 20).cast("long")
    marker = F.when(n % 11 != 0, F.concat(F.lit("m"), (n % 7).cast("string")))
    return accounts_to_add(
        a.account_candidates(spark, sf).withColumn("marker", marker), a.accounts(spark, sf)
    )


# -- KPIs ----------------------------------------------------------------------------------


def kpi_category_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.total_per_category(
        _orders_fact(spark, sf),
        filter_category=["1-URGENT", "5-LOW", "no such category"],
        filter_start_date="1996-03-01",
        filter_end_date="1999-11-30",
    )


def kpi_category_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts below a millionth, of money, with endless fractions and beyond 10^9, to 12 digits."""
    key = F.col("id").cast("long")
    price = F.col("expend_amount")
    amount = (
        F.when(key % 4 == 0, 4e-7).when(key % 4 == 1, price).when(key % 4 == 2, price / 3).otherwise(price * 1e6)
    )
    group = F.concat(F.lit("g"), (key % 9 + key % 4).cast("string"))
    fact = _orders_fact(spark, sf).withColumns({"expend_amount": amount, "parent_category": group})
    totals = kpis.total_per_category(fact)
    return totals.select("parent_category", F.format_string("%.11e", "expend_amount").alias("total"))


def _fact_kpi(kpi: Callable[[DataFrame], DataFrame], fact: Query) -> Query:
    return lambda spark, sf: kpi(fact(spark, sf))


QUERIES: dict[str, Query] = {
    "scan_fact": scan_fact,
    "fct_expense": fct_expense,
    "fct_incremental": fct_incremental,
    "append_bronze": append_bronze,
    "date_parts": date_parts,
    "season_label": season_label,
    "normalize_header": normalize_header,
    "default_category": default_category,
    "coerce_amount": coerced_amount,
    "parse_date": parsed_date,
    "validate_rows": checked_rows,
    "validate_file_nulls": validate_file_nulls,
    "validate_file_nonnumeric": validate_file_nonnumeric,
    "dup_groups": dup_groups,
    "dup_vs_fact": dup_vs_fact,
    "file_already_imported": file_already_imported,
    "pk_violations": pk_violations,
    "file_gate": file_gate,
    "file_quarantine": file_quarantine,
    "date_order": date_order,
    "dates_in_order": dates_in_order,
    "import_log": import_log,
    "row_gate": row_gate,
    "form_labels": form_labels,
    "iso_date": iso_date,
    "file_logged_exact": file_logged_exact,
    "ledger_raw": ledger_raw,
    "ledger_fact": ledger_fact,
    "ledger_import": ledger_import,
    "ledger_frame": ledger_frame,
    "ledger_seed": ledger_seed,
    "ledger_stream": ledger_stream,
    "ledger_submit": ledger_submit,
    "ledger_submitted": ledger_submitted,
    "ledger_export": ledger_export,
    "ledger_log": ledger_log,
    "mart_incremental": mart_incremental,
    "mart_kept_others": mart_kept_others,
    "mart_of_years": mart_of_years,
    "cumulative_after_late_batch": cumulative_after_late_batch,
    "kpi_stream": kpi_stream,
    "dup_vs_fact_bucketed": dup_vs_fact_bucketed,
    "file_imported_indexed": file_imported_indexed,
    "seed_accounts": seed_accounts,
    "accounts_repeated": accounts_repeated,
    "kpi_headline": _fact_kpi(kpis.headline, _orders_fact),
    "kpi_category": _fact_kpi(kpis.total_per_category, _orders_fact),
    "kpi_category_filtered": kpi_category_filtered,
    "kpi_category_wide": kpi_category_wide,
    "kpi_monthly": _fact_kpi(kpis.monthly_trend, _orders_fact),
    "kpi_weekday_avg": _fact_kpi(kpis.weekday_average, _orders_fact),
    "kpi_top10": _fact_kpi(kpis.highest_expenses, _orders_fact),
    "kpi_season": _fact_kpi(kpis.seasonal_breakdown, _items_fact),
    "kpi_account": _fact_kpi(kpis.account_summary, _items_fact),
    "kpi_tag": _fact_kpi(kpis.category_tag_insights, _tagged_fact),
    "kpi_towards": _fact_kpi(kpis.towards_analysis, _items_fact),
    "kpi_balances": _fact_kpi(kpis.account_balances, a.accounts),
    "kpi_cumulative": _fact_kpi(kpis.cumulative_trend, _orders_fact),
    "kpi_mart": _fact_kpi(kpi_mart, _items_fact),
}


def registered() -> dict[str, Query]:
    """The queries, each on a session with the settings of ``session.tune``."""

    def tuned(query: Query) -> Query:
        return lambda spark, sf: query(tune(spark), sf)

    return {name: tuned(query) for name, query in QUERIES.items()}

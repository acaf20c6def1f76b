"""Rows of rejected files with their faults, and the order of day and month in files."""

import datetime as dt
import itertools

import pytest

from coinbrook.operators.date_order import date_orders, with_month_first
from coinbrook.operators.quarantine import quarantined
from coinbrook.plans.ledger import Ledger

HEADER = "Date,Description,Amount,From Account,To Account\n"
AS_OF = dt.datetime(2026, 1, 2)
_numbers = itertools.count()
pytestmark = pytest.mark.usefixtures("without_compilation")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"held{next(_numbers)}", f"{tmp_path}/ledger", AS_OF)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "".join(f"{r}\n" for r in rows))


def test_rows_of_rejected_files_are_kept_with_their_faults(ledger, tmp_path):
    landing = tmp_path / "in"
    write(landing, "good.csv", ["2025-01-01,tea,1,n26,home"])
    write(landing, "amount.csv", ["2025-01-01,tea,x,n26,home", "2025-01-02,tea,1,n26,home", ",tea,1,n26,home"])
    write(landing, "twice.csv", ["2025-01-01,tea,1,n26,home", "2025-01-01,bun,1.0,n26,home", "2025-01-03,bun,2,n26,home"])
    write(landing, "date.csv", ["hello,tea,1,n26,home", "2025-01-02,tea,1,n26,home"])
    write(landing, "long.csv", ['2025-01-01,tea,1,n26,home,"more"'])
    ledger.import_files([str(landing)], "b1")
    held = {}
    for r in ledger.quarantine().collect():
        name = r.file.rsplit("/", 1)[-1]
        held.setdefault(name, []).append((r.description, r.error_field, r.error_reason, r.error_value))
    assert {n: sorted(rows, key=repr) for n, rows in held.items()} == {
        "amount.csv": [
            ("tea", "amount", "Amount must be a valid number", "x"),
            ("tea", "date", "Missing value", None),
            ("tea", None, "File rejected: structure", None),
        ],
        "twice.csv": [
            ("bun", None, "File rejected: duplicate rows", None),
            ("bun", None, "Row occurs more than once in the file", "2"),
            ("tea", None, "Row occurs more than once in the file", "2"),
        ],
        "date.csv": [("tea", "date", "Invalid date format", "hello"), ("tea", None, "File rejected: bad dates", None)],
        "long.csv": [("tea", None, "More fields than the header", "more")],
    }
    assert ledger.expenses().count() == 1
    ledger.import_files([str(landing)], "b1")
    assert ledger.quarantine().count() == 9
    ledger.import_files([str(landing / "good.csv")], "b2")
    again = ledger.quarantine().filter("batch_id = 'b2'").collect()
    assert [(r.error_reason, r.error_value) for r in again] == [("File rejected: already imported", "good.csv")]


def test_strict_checks_and_a_frame_without_columns(frame):
    rows = frame([("f", "2025-01-01", "a-b", "1"), ("f", "2025-01-01", "ab", "-1")], "file string, date string, description string, amount string")
    verdicts = frame([("f", "structure", None)], "file string, status string, imported_as string")
    loose = sorted((r.error_field, r.error_reason) for r in quarantined(rows, verdicts, "accepted").collect() if r.error_field)
    assert loose == []
    strict = sorted(r.error_field for r in quarantined(rows, verdicts, "accepted", strict=True).collect())
    assert strict == ["amount", "description"]


ORDERS = {
    "iso.csv": (["2025-01-31", None], None),
    "month.csv": (["01/02/2025", "01/31/2025"], "month first"),
    "day.csv": (["01/02/2025", "31/01/2025", "soon", "2025-03-01"], "day first"),
    "open.csv": (["01/02/2025", "03/04/2025"], "ambiguous"),
    "same.csv": (["01/01/2025", "5/5/2025"], "month first"),
    "mixed.csv": (["01/31/2025", "31/01/2025"], "mixed"),
    "none.csv": (["45/45/2025"], None),
}


def test_date_orders(frame):
    rows = frame([(f, d) for f, (dates, _) in ORDERS.items() for d in dates], "file string, date string").repartition(5)
    orders = date_orders(rows)
    assert {r.file: r.date_order for r in orders.collect()} == {f: order for f, (_, order) in ORDERS.items()}
    turned = {}
    for r in with_month_first(rows, orders).collect():
        turned.setdefault(r.file, set()).add(r.date)
    assert turned["day.csv"] == {"2025-02-01", "2025-01-31", "soon", "2025-03-01"}
    assert turned["month.csv"] == {"01/02/2025", "01/31/2025"}


def test_a_day_first_file_is_imported(ledger, tmp_path):
    landing = tmp_path / "in"
    write(landing, "day.csv", ["03/02/2025,tea,1,n26,home", "15/02/2025,tea,2,n26,home"])
    write(landing, "open.csv", ["03/02/2025,bun,3,n26,home"])
    write(landing, "mixed.csv", ["02/15/2025,bun,3,n26,home", "15/02/2025,bun,4,n26,home"])
    report = {r.filename: (r.status, r.date_order) for r in ledger.import_files([str(landing)]).collect()}
    assert report == {
        "day.csv": ("accepted", "day first"),
        "open.csv": ("accepted", "ambiguous"),
        "mixed.csv": ("bad dates", "mixed"),
    }
    dates = sorted((r.amount, str(r.date)) for r in ledger.expenses().collect())
    assert dates == [(1.0, "2025-02-03"), (2.0, "2025-02-15"), (3.0, "2025-03-02")]

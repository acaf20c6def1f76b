import datetime as dt

import pytest

from coinbrook.operators import normalize
from coinbrook.operators.duplicates import (
    duplicate_groups,
    key_violations,
    mark_repeated,
)
from coinbrook.operators.gates import gate_files, gate_rows
from coinbrook.operators.validation import (
    BAD_SYMBOLS,
    MISSING_FIELDS,
    NOT_A_DATE,
    NOT_A_NUMBER,
    NOT_POSITIVE,
    check_file_rows,
    validate_file,
    validate_rows,
)
from coinbrook.plans.fact import build_fact

BASE = {
    "Description": "lunch",
    "Date": "2025-01-02",
    "Amount": "12.5",
    "Category": "food",
    "From Account": "n26",
    "To Account": "home",
}
FORM = "entry int, " + ", ".join(f"`{f}` string" for f in BASE)
FILE = "date string, description string, amount string, from_account string, towards string"
LINES = "id string, date date, description string, category string, amount double, from_account string, towards string"

pytestmark = pytest.mark.usefixtures("without_compilation")


def form_rows(frame, *changes):
    return frame([(i, *{**BASE, **c}.values()) for i, c in enumerate(changes)], FORM)


@pytest.mark.parametrize(
    "change, field, reason",
    [
        ({}, None, None),
        ({"Description": "x_y"}, None, None),
        ({"Description": "it's; a"}, None, None),
        ({"Description": "a-b"}, "Description", BAD_SYMBOLS),
        ({"Description": "a.b"}, "Description", BAD_SYMBOLS),
        ({"Description": "a-b", "Amount": "-5"}, "Description", BAD_SYMBOLS),
        ({"Amount": "0"}, "Amount", NOT_POSITIVE),
        ({"Amount": "-5"}, "Amount", NOT_POSITIVE),
        ({"Amount": "-5", "Date": "hello"}, "Amount", NOT_POSITIVE),
        ({"Amount": "abc"}, "Amount", NOT_A_NUMBER),
        ({"Amount": "1,000"}, "Amount", NOT_A_NUMBER),
        ({"Amount": "1d"}, "Amount", NOT_A_NUMBER),
        ({"Amount": "0x10"}, "Amount", NOT_A_NUMBER),
        ({"Amount": "nan"}, "Amount", NOT_A_NUMBER),
        ({"Amount": "inf"}, "Amount", NOT_A_NUMBER),
        ({"Amount": "1_000"}, "Amount", NOT_A_NUMBER),
        ({"Date": "hello"}, "Date", NOT_A_DATE),
        ({"Date": "2025-02-30"}, "Date", NOT_A_DATE),
    ],
)
def test_validate_rows(frame, change, field, reason):
    row = validate_rows(form_rows(frame, change)).first()
    assert (row.is_valid, row.error_field, row.error_reason) == (reason is None, field, reason)
    assert row.error_value == ({**BASE, **change}[field] if field else None)
    assert row.missing_fields == []


def test_missing_fields(frame):
    changes = [{"Category": "  "}, {"Category": "\t"}, {"Date": None, "To Account": ""}]
    got = validate_rows(form_rows(frame, *changes)).orderBy("entry").collect()
    assert [r.missing_fields for r in got] == [["Category"], ["Category"], ["Date", "To Account"]]
    assert {r.error_reason for r in got} == {MISSING_FIELDS}


def test_missing_form_column(frame):
    row = validate_rows(form_rows(frame, {}).drop("Amount")).first()
    assert (row.is_valid, row.missing_fields) == (False, ["Amount"])


def report(frame, rows, schema=FILE, strict=False):
    return validate_file(frame(rows, schema), strict).first()


def test_validate_file(frame):
    good = ("2025-01-02", "lunch", "12.5", "n26", "home")
    assert report(frame, [good]).is_valid
    assert report(frame, [good[:2] + ("-12",) + good[3:]]).is_valid
    row = report(frame, [good, good[:1] + (None,) + good[2:]])
    assert row.errors == ["Null values found in: description"]
    row = report(frame, [good, good[:2] + (None,) + good[3:], good[:2] + ("x",) + good[3:]])
    assert row.errors == ["Null values found in: amount", "2 rows have non-numeric amounts"]
    row = report(frame, [good[:2] + good[3:]], FILE.replace("amount string, ", ""))
    assert row.errors == ["Missing columns: amount"]
    assert report(frame, [], FILE).is_valid


def test_validate_file_strict(frame):
    rows = [("hello", "a-b", "-1", "n26", "home"), ("2025-01-01", "x", "nan", "n26", "home")]
    errors = report(frame, rows, strict=True).errors
    assert errors == [
        "1 rows have non-numeric amounts",
        "1 rows have prohibited symbols in the description",
        "2 rows have amounts that are not positive",
        "1 rows have dates of unknown format",
    ]


def test_normalize_header(frame):
    df = frame([("1", "2")], "`From Account` string, `To Account` string")
    assert normalize.normalize_header(df).columns == ["from_account", "towards"]
    df = frame([("1", "2")], "Towards string, `To Account` string")
    got = normalize.normalize_header(df)
    assert got.columns == ["towards"] and got.first()[0] == "1"


def test_to_expenses_line(frame):
    df = form_rows(frame, {}, {"Amount": "x"}, {"Date": None}).drop("Category")
    rows = normalize.to_expenses_line(df).collect()
    assert sorted(r.amount for r in rows) == [0.0, 12.5, 12.5]
    assert {r.category for r in rows} == {"Uncategorized"}
    assert {r.date for r in rows} == {dt.date(2025, 1, 2), None}
    assert len({r.id for r in rows}) == 3
    with pytest.raises(Exception, match="not a date: hello"):
        normalize.to_expenses_line(form_rows(frame, {"Date": "hello"})).collect()


def test_duplicate_groups(frame):
    rows = [
        ("2025-01-01", "a", "1", "n26", "home"),
        ("2025-01-01", "b", "1", "n26", "home"),
        ("2025-01-01", "a", "1", None, "home"),
        ("2025-01-01", "a", "1", None, "home"),
        ("2025-01-02", "a", "1", "n26", "home"),
    ]
    got = [tuple(r) for r in duplicate_groups(frame(rows, FILE)).collect()]
    assert got == [("2025-01-01", 1.0, "n26", "home", 2)]


def test_amounts_of_equal_value_are_duplicates_in_a_file(frame):
    rows = [("2025-01-01", "a", "1", "n26", "home"), ("2025-01-01", "b", "1.0", "n26", "home")]
    assert check_file_rows(frame(rows, FILE)).first().duplicate_groups == 1


def test_key_violations(frame):
    rows = frame([("a",), ("a",), ("b",), (None,)], "id string")
    assert {tuple(r) for r in key_violations(rows, ["id"]).collect()} == {("a", 2), (None, 1)}


@pytest.fixture
def fact(frame):
    day = dt.date(2025, 1, 2)
    rows = [
        ("f2", day, "LUNCH", "food", 12.5, "n26", "home"),
        ("f1", day, "Lunch", "food", 12.5, "n26", "home"),
        ("f3", day, "rent", None, 700.0, "n26", "home"),
    ]
    return build_fact(frame(rows, LINES))


def test_mark_repeated(frame, fact):
    rows = form_rows(
        frame,
        {},
        {"Amount": "12.50", "Date": "2025-1-2"},
        {"Amount": "12.51"},
        {"Description": "rent", "Category": None, "Amount": "700"},
    )
    got = mark_repeated(rows, fact).orderBy("entry").collect()
    assert [r.duplicate_of and r.duplicate_of.id for r in got] == ["f1", "f1", None, None]
    assert got[0].duplicate_of.description == "Lunch"


def test_gate_rows(frame, fact):
    rows = form_rows(
        frame,
        {},
        {"Description": "tea"},
        {"Description": "TEA"},
        {"Description": "tea", "Amount": "bad"},
        {"Description": "tea", "Category": "drinks"},
    )
    got = gate_rows(rows, fact, "entry").orderBy("entry").collect()
    assert [r.status for r in got] == ["duplicate", "accepted", "duplicate", "invalid", "accepted"]
    assert got[0].duplicate_of.id == "f1" and got[2].duplicate_of is None


def test_gate_rows_with_one_hot_key(spark, frame, fact):
    """A third of the batch is one and the same row: one is accepted, none is lost."""
    changes = [{"Description": "tea" if i % 3 == 0 else f"item {i}"} for i in range(900)]
    got = gate_rows(form_rows(frame, *changes), fact, "entry")
    counts = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    assert counts == {"accepted": 601, "duplicate": 299}
    assert got.filter("status = 'accepted' and Description = 'tea'").first().entry == 0


FILES = "file string, filename string, arrival int, missing_columns array<string>"
LOG = "id string, ts timestamp, filename string, date_imported string, no_of_rows_imported int"


def test_gate_files(frame):
    ok = ("2025-01-01", "a", "1", "n26", "home")
    rows = {
        "good": [ok, ("2025-01-01", "a", "2", "n26", "home")],
        "null": [ok[:1] + (None,) + ok[2:], ok, ok],
        "known": [ok, ok],
        "twice": [ok, ok],
        "date": [("hello", *ok[1:])],
        "later": [ok],
        "empty": [],
        "headless": [],
    }
    names = {"known": "data.csv", "good": "fine.csv", "later": "ine.csv"}
    files = [
        (k, names.get(k, f"{k}.txt"), i, ["amount"] if k == "headless" else [])
        for i, k in enumerate(rows)
    ]
    log = [("1", None, "old_data.csv", "2025-01-01", 5), ("2", None, "x", "2025-01-01", 1)]
    got = gate_files(
        frame(files, FILES),
        frame([(k, *r) for k, rs in rows.items() for r in rs], "file string, " + FILE),
        frame(log, LOG),
    )
    status = {r.file: r.status for r in got.collect()}
    assert status == {
        "good": "accepted",
        "null": "structure",
        "known": "already imported",
        "twice": "duplicate rows",
        "date": "bad dates",
        "later": "already imported",
        "empty": "accepted",
        "headless": "structure",
    }
    found = {r.file: r for r in got.collect()}
    assert found["known"].imported_as.filename == "old_data.csv"
    assert found["empty"].row_count == 0 and found["good"].row_count == 2
    assert found["headless"].errors == ["Missing columns: amount"]
    exact = gate_files(
        frame(files, FILES),
        frame([(k, *r) for k, rs in rows.items() for r in rs], "file string, " + FILE),
        frame(log, LOG),
        match="exact",
    )
    status = {r.file: r.status for r in exact.collect()}
    assert status["known"] == "duplicate rows" and status["later"] == "accepted"


def test_a_rejected_file_does_not_block_a_later_one(frame):
    files = [("a", "x_data.csv", 1, []), ("b", "data.csv", 2, []), ("c", "ata.csv", 3, [])]
    ok = ("2025-01-01", "a", "1", "n26", "home")
    rows = [("a", *ok), ("a", *ok), ("b", *ok), ("c", *ok)]
    got = gate_files(frame(files, FILES), frame(rows, "file string, " + FILE), frame([], LOG))
    status = {r.file: r.status for r in got.collect()}
    assert status == {"a": "duplicate rows", "b": "accepted", "c": "already imported"}

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from coinbrook.plans.fact import build_fact
from coinbrook.plans.ledger import Ledger
from coinbrook.schemas import DIM_ACCOUNT, TABLES
from coinbrook.streaming.continuous import import_stream

HEADER = "Date,Description,Amount,From Account,To Account\n"
AS_OF = dt.datetime(2026, 1, 2, 3, 4, 5)
FORM = (
    "entry int, Description string, Date string, Amount string, Category string, "
    "`From Account` string, `To Account` string"
)
_numbers = itertools.count()
pytestmark = pytest.mark.usefixtures("without_compilation")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"ledger{next(_numbers)}", f"{tmp_path}/ledger", AS_OF)


def write(folder, name, rows, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(header + "".join(f"{r}\n" for r in rows))


def same_rows(one, other):
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def fact_is_complete(ledger):
    return same_rows(ledger.fact(), build_fact(ledger.expenses(), AS_OF))


def status(report):
    return {r.filename: r.status for r in report.collect()}


def test_a_new_ledger(spark, ledger):
    for name, schema in TABLES.items():
        frame = ledger.tables.read(name)
        assert [(f.name, f.dataType) for f in frame.schema] == [
            (f.name, f.dataType) for f in schema
        ]
    assert sorted(ledger.tables.names()) == sorted(TABLES)
    assert {r.marker for r in ledger.accounts().collect()} == {"n26", "wise", "deutsche_bank", "icici"}
    again = Ledger(spark, ledger.tables.database, ledger.tables.location, AS_OF)
    assert again.accounts().count() == 4
    assert ledger.fact().isEmpty()


def test_reopening_keeps_the_rows(spark, ledger, frame):
    ledger.insert(frame([("2025-01-01", "a", "1", "n26", "home")], "Date string, Description string, Amount string, `From Account` string, `To Account` string"))
    again = Ledger(spark, ledger.tables.database, ledger.tables.location, AS_OF)
    assert again.expenses().count() == 1 and again.fact().count() == 1


def test_add_accounts(ledger, frame):
    rows = [("x", "X", None, "cash", "t", 0.0, 0.0, 5.0, "EUR"), ("y", "Y", None, "n26", "t", 0.0, 0.0, 5.0, "EUR")]
    ledger.add_accounts(frame(rows, DIM_ACCOUNT))
    assert {r.marker: r.id for r in ledger.accounts().collect()}["cash"] == "x"
    assert ledger.accounts().count() == 5


def test_a_file_with_an_open_quote_is_rejected(ledger, tmp_path):
    landing = tmp_path / "landing"
    write(landing, "sound.csv", ["2025-01-01,tea,1.5,n26,home"])
    write(landing, "open.csv", ["2025-01-02,rent,700,wise,home", '2025-01-03,tea,1,n26,"home', "2025-01-04,tea,2,n26,home"])
    assert status(ledger.import_files([str(landing)])) == {"sound.csv": "accepted", "open.csv": "structure"}
    assert ledger.expenses().count() == 1


def test_import_files(ledger, tmp_path):
    landing = tmp_path / "landing"
    write(landing, "jan.csv", ["2025-01-01,tea,1.5,n26,home", "2025-01-02,rent,700,wise,home"])
    write(landing, "feb.csv", ["2025-02-01,tea,x,n26,home"])
    write(landing, "mar.csv", ["2025-03-01,tea,1,n26,home"] * 2)
    write(landing, "apr.csv", ["2025-04-01,tea,1,n26"], "Date,Description,Amount,From Account\n")
    write(landing, "none.csv", [])
    report = ledger.import_files([str(landing)])
    assert status(report) == {
        "jan.csv": "accepted",
        "feb.csv": "structure",
        "mar.csv": "duplicate rows",
        "apr.csv": "structure",
        "none.csv": "accepted",
    }
    assert ledger.expenses().count() == 2
    assert {r.category for r in ledger.expenses().collect()} == {"Uncategorized"}
    log = {r.filename: r for r in ledger.import_log().collect()}
    assert {n: r.no_of_rows_imported for n, r in log.items()} == {"jan.csv": 2, "none.csv": 0}
    assert (log["jan.csv"].date_imported, log["jan.csv"].ts) == ("2026-01-02", AS_OF)
    assert fact_is_complete(ledger)

    second = ledger.import_files([str(landing / "jan.csv")])
    assert status(second) == {"jan.csv": "already imported"}
    assert second.first().imported_as == "jan.csv"
    assert ledger.expenses().count() == 2 and ledger.import_log().count() == 2


def test_ids_of_files(ledger, tmp_path):
    landing, header = tmp_path / "in", "id," + HEADER

    def import_one(name, *ids):
        rows = [f"{i},2025-01-0{n},tea,1,n26,home" for n, i in enumerate(ids, 1)]
        write(landing, name, rows, header)
        return status(ledger.import_files([str(landing / name)]))[name]

    assert import_one("a.csv", "1", "2") == "accepted"
    assert import_one("b.csv", "3", "3") == "bad ids"
    assert import_one("c.csv", "3", "") == "bad ids"
    assert import_one("d.csv", "3", "2") == "bad ids"
    assert import_one("e.csv", "3", "4") == "accepted"
    assert sorted(r.id for r in ledger.fact().collect()) == ["1", "2", "3", "4"]
    both = tmp_path / "both"
    write(both, "f.csv", ["8,2025-01-01,tea,1,n26,home"], header)
    write(both, "g.csv", ["8,2025-01-01,tea,1,n26,home"], header)
    assert sorted(status(ledger.import_files([str(both)])).values()) == ["accepted", "bad ids"]


def test_an_insert_does_not_read_the_fact_table(ledger, frame, monkeypatch):
    monkeypatch.setattr(Ledger, "fact", lambda self: pytest.fail("the fact table was read"))
    ledger.insert(frame([(1, "x", "2025-01-01", "1", "c", "a", "b")], FORM))


def test_a_batch_can_be_repeated(ledger, tmp_path):
    write(tmp_path / "in", "jan.csv", ["2025-01-01,tea,1.5,n26,home"])
    ledger.import_files([str(tmp_path / "in")], "b1")
    before = ledger.expenses().collect()
    report = ledger.import_files([str(tmp_path / "in")], "b1")
    assert status(report) == {"jan.csv": "accepted"}
    assert ledger.expenses().collect() == before
    assert ledger.fact().count() == 1 and ledger.import_log().count() == 1


@pytest.mark.parametrize("broken_step", ["_land_files", "_log_files", "sync_fact"])
def test_a_failed_batch_is_finished_by_its_repeat(ledger, tmp_path, monkeypatch, broken_step):
    write(tmp_path / "in", "jan.csv", ["2025-01-01,tea,1.5,n26,home", "2025-01-02,bun,2,n26,home"])

    def fail(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, broken_step, fail)
        with pytest.raises(RuntimeError, match="lost"):
            ledger.import_files([str(tmp_path / "in")], "b1")
    ledger.import_files([str(tmp_path / "in")], "b1")
    assert ledger.expenses().count() == 2
    assert ledger.import_log().count() == 1
    assert fact_is_complete(ledger)


def test_import_frame(ledger, frame):
    schema = "Date string, Description string, Amount double, `From Account` string, `To Account` string"
    rows = frame([("2025-01-01", "a", 1.0, "n26", "home")], schema)
    assert status(ledger.import_frame(rows)) == {"dataframe_upload": "accepted"}
    assert status(ledger.import_frame(rows)) == {"dataframe_upload": "already imported"}
    assert status(ledger.import_frame(rows, "other")) == {"other": "accepted"}
    lacking = ledger.import_frame(rows.drop("Date", "Amount"), "third")
    assert status(lacking) == {"third": "structure"}
    assert lacking.first().errors == ["Missing columns: date, amount"]
    assert ledger.expenses().count() == 2 and ledger.import_log().count() == 2


def test_submit_rows(ledger, frame):
    base = ("lunch", "2025-01-02", "12.5", "food", "n26", "home")
    first = frame([(2, *base), (1, *base), (3, "a-b", *base[1:]), (4, "tea", *base[1:])], FORM)
    report = {r.entry: r for r in ledger.submit_rows(first, "b1").collect()}
    assert {e: r.status for e, r in report.items()} == {
        1: "accepted", 2: "duplicate", 3: "invalid", 4: "accepted",
    }
    assert ledger.expenses().count() == 2 and fact_is_complete(ledger)
    again = ledger.submit_rows(first, "b1")
    assert {r.entry: r.status for r in again.collect()} == {e: r.status for e, r in report.items()}
    assert ledger.expenses().count() == 2
    second = ledger.submit_rows(frame([(1, "LUNCH", *base[1:])], FORM), "b2").first()
    assert (second.status, second.duplicate_of) == ("duplicate", report[1].submission_id)
    assert ledger.fact().count() == 2 and ledger.import_log().isEmpty()


def test_seed(ledger, tmp_path):
    write(tmp_path / "in", "seed.csv", ["2025-01-01,tea!,bad,n26,home", "2025-01-01,tea!,bad,n26,home"])
    path = str(tmp_path / "in" / "seed.csv")
    assert ledger.seed(path) is True
    assert [r.amount for r in ledger.expenses().collect()] == [0.0, 0.0]
    assert len({r.id for r in ledger.fact().collect()}) == 2
    assert ledger.import_log().isEmpty()
    assert ledger.seed(path) is False


def test_a_bad_date_fails_the_insert(ledger, frame):
    rows = frame([(1, "x", "2025-01-01", "1", "c", "a", "b"), (2, "x", "hello", "1", "c", "a", "b")], FORM)
    with pytest.raises(Exception, match="not a date"):
        ledger.insert(rows)
    assert ledger.expenses().isEmpty() and ledger.fact().isEmpty()


def test_refresh_equals_sync(ledger, frame):
    for day in ("2024-12-31", "2025-01-01", None):
        ledger.insert(frame([(1, "x", day, "1", "c", "a", "b")], FORM))
    assert ledger.fact().count() == 3
    synced = ledger.fact().collect()
    for version in (2, 3, 4):
        ledger.refresh_fact()
        assert ledger.tables.fact_version() == version
    assert sorted(ledger.fact().collect(), key=str) == sorted(synced, key=str)
    ledger.sync_fact()
    assert fact_is_complete(ledger)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_export(spark, ledger, frame, tmp_path, kind):
    ledger.insert(frame([(1, 'say "hi", you', "2025-01-01", "1.5", "c", "a", "b\nc")], FORM))
    paths = ledger.export(str(tmp_path / "out"), kind.upper())
    assert {p.rsplit("/", 1)[-1] for p in paths.values()} == {
        f"export_{t}_2026_01_02.{kind}" for t in TABLES
    }
    for name, path in paths.items():
        table = ledger.tables.read(name)
        reader = spark.read.schema(table.schema)
        if kind == "csv":
            reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
            back = reader.csv(path)
        else:
            back = reader.parquet(path)
        assert same_rows(back, table), name


def test_export_of_another_kind(ledger, tmp_path):
    with pytest.raises(ValueError, match="export format"):
        ledger.export(str(tmp_path), "xlsx")


def test_stream_equals_batch(spark, ledger, tmp_path):
    landing = tmp_path / "landing"
    write(landing, "a.csv", ["2025-01-01,tea,1.5,n26,home"])
    write(landing, "b.csv", ["2025-01-02,tea,1.5,n26,home"])
    write(landing, "notes.txt", ["not for us"])
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        query = import_stream(ledger, str(landing), checkpoint, files_per_batch=1)
        query.awaitTermination()

    run()
    assert {r.filename for r in ledger.import_log().collect()} == {"a.csv", "b.csv"}
    write(landing, "c.csv", ["2025-01-03,tea,1.5,n26,home"])
    run()
    run()
    assert ledger.import_log().count() == 3

    batch = Ledger(spark, f"ledger{next(_numbers)}", f"{tmp_path}/batch", AS_OF)
    batch.import_files([str(landing / f) for f in ("a.csv", "b.csv", "c.csv")])
    columns = [c for c in batch.expenses().columns if c != "id"]
    assert same_rows(batch.expenses().select(columns), ledger.expenses().select(columns))
    assert fact_is_complete(ledger)


def test_a_date_filter_reads_only_its_years(ledger, frame):
    for day in ("2024-12-31", "2025-01-01"):
        ledger.insert(frame([(1, "x", day, "1", "c", "a", "b")], FORM))
    from coinbrook.plans.kpis import filter_expenses

    rows = filter_expenses(ledger.fact(), filter_start_date="2025-01-01")
    assert len(rows.inputFiles()) <= 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows.select(F.max("expense_date")).first()[0] == dt.date(2025, 1, 1)


# -- batches that must not swallow files ---------------------------------------------------


def test_a_batch_id_holds_its_files(ledger, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    write(one, "a.csv", ["2025-01-01,tea,1,n26,home"])
    write(one, "b.csv", ["2025-01-02,tea,1,n26,home"])
    write(two, "c.csv", ["2025-01-03,tea,1,n26,home"])
    ledger.import_files([str(one)], "day")
    with pytest.raises(ValueError, match="c.csv"):
        ledger.import_files([str(two)], "day")
    with pytest.raises(ValueError, match="b.csv"):
        ledger.import_files([str(one / "a.csv")], "day")
    (one / "a.csv").write_text(HEADER + "2025-01-09,milk,7,n26,home\n")
    os.utime(one / "a.csv", (1, 1))
    with pytest.raises(ValueError, match="a.csv"):
        ledger.import_files([str(one)], "day")
    assert ledger.expenses().count() == 2


def test_a_file_that_left_before_the_repeat(ledger, tmp_path, monkeypatch):
    landing = tmp_path / "in"
    write(landing, "a.csv", ["2025-01-01,tea,1,n26,home"])
    write(landing, "b.csv", ["2025-01-02,tea,1,n26,home"])
    with monkeypatch.context() as patched:
        patched.setattr(ledger, "_land_files", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.import_files([str(landing)], "day")
    (landing / "b.csv").rename(tmp_path / "b.csv")
    with pytest.raises(ValueError, match="b.csv"):
        ledger.import_files([str(landing)], "day")
    assert ledger.import_log().isEmpty()


def test_streams_of_one_name(ledger, tmp_path):
    for k, (folder, checkpoint) in enumerate([("x", "c1"), ("y", "c2"), ("x", "c3")]):
        write(tmp_path / folder, f"f{k}.csv", [f"2025-01-0{k + 1},tea,1,n26,home"])
        import_stream(ledger, str(tmp_path / folder), str(tmp_path / checkpoint)).awaitTermination()
    assert {r.filename for r in ledger.import_log().collect()} == {"f0.csv", "f1.csv", "f2.csv"}


def test_an_interrupted_seed(ledger, tmp_path, monkeypatch):
    write(tmp_path / "s", "seed.csv", ["2025-01-01,tea,1,n26,home"])
    with monkeypatch.context() as patched:
        patched.setattr(ledger, "sync_fact", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.seed(str(tmp_path / "s" / "seed.csv"))
    assert ledger.seed(str(tmp_path / "s" / "seed.csv")) is False
    assert ledger.fact().count() == 1


def test_ids_of_a_rejected_file_block_no_other(ledger, tmp_path):
    landing = tmp_path / "in"
    write(landing, "a.csv", ["7,2025-01-01,tea,bad,n26,home"], "id," + HEADER)
    write(landing, "b.csv", ["7,2025-01-01,tea,1,n26,home"], "id," + HEADER)
    write(landing, "c.csv", ["7,2025-01-02,tea,1,n26,home", "8,2025-01-02,cake,2,n26,home"], "id," + HEADER)
    write(landing, "d.csv", ["8,2025-01-03,tea,1,n26,home"], "id," + HEADER)
    for k, name in enumerate("abcd"):
        os.utime(landing / f"{name}.csv", (1000 + k, 1000 + k))
    got = status(ledger.import_files([str(landing)]))
    assert got == {"a.csv": "structure", "b.csv": "accepted", "c.csv": "bad ids", "d.csv": "accepted"}


def test_ids_of_frames_and_inserts(ledger, frame):
    columns = "id string, Date string, Description string, Amount string, `From Account` string, `To Account` string"

    def rows(*ids):
        return frame([(i, f"2025-01-{n:02}", "tea", "1", "n26", "home") for n, i in enumerate(ids, 1)], columns)

    assert status(ledger.import_frame(rows("k", "k"), "one")) == {"one": "bad ids"}
    assert status(ledger.import_frame(rows("k", None), "two")) == {"two": "bad ids"}
    assert status(ledger.import_frame(rows("k", "l"), "three")) == {"three": "accepted"}
    for bad in (("k",), ("m", "m"), (None,)):
        with pytest.raises(ValueError, match="ids"):
            ledger.insert(rows(*bad))
    ledger.insert(rows("m"))
    assert sorted(r.id for r in ledger.fact().collect()) == ["k", "l", "m"]


def test_one_account_for_each_marker(ledger, frame):
    rows = frame([("b", "x", "new"), ("a", "y", "new"), ("c", "z", "n26"), ("d", "q", None)], "id string, name string, marker string")
    full = [f.name for f in TABLES["dim_account"]]
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in full])
    ledger.add_accounts(rows)
    added = {(r.id, r.marker) for r in ledger.accounts().collect() if r.id in "abcd"}
    assert added == {("a", "new"), ("d", None)}


def test_the_mart_is_swapped(ledger, frame):
    from coinbrook.plans.mart import read_kpi

    for n in (1, 2, 3):
        ledger.insert(frame([(1, "x", f"2025-01-0{n}", str(n), "c", "a", "b")], FORM))
        mart = ledger.refresh_mart()
    assert read_kpi(mart, "headline").collect()[0].total == 6.0
    assert [r.total for r in read_kpi(mart, "top").collect()] == [3.0, 2.0, 1.0]
    assert read_kpi(mart, "category").collect()[0].total == 6.0


def test_a_seed_parses_its_file_once(ledger, tmp_path, monkeypatch):
    folder = tmp_path / "once"
    folder.mkdir()
    header = "id,Date,Description,Amount,From Account,To Account"
    (folder / "seed.csv").write_text(f"{header}\n7,2025-01-01,tea,1,n26,home\n")
    taken, insert = [], Ledger.insert
    monkeypatch.setattr(Ledger, "insert", lambda self, rows, batch: (taken.extend(rows.inputFiles()), insert(self, rows, batch)))
    assert ledger.seed(str(folder / "seed.csv")) is True
    assert taken and all(file.endswith(".parquet") for file in taken)
    assert [(r.id, r.amount) for r in ledger.expenses().collect()] == [("7", 1.0)]

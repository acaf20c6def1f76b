"""A batch shows up as a whole, and ids are checked by stored filters."""

import datetime as dt
import itertools

import pytest

from coinbrook.operators.id_filter import filter_of, may_be_known
from coinbrook.plans.ledger import Ledger
from coinbrook.plans.mart import read_kpi
from coinbrook.sinks.tables import LedgerTables

AS_OF = dt.datetime(2026, 1, 2)
HEADER = "Date,Description,Amount,From Account,To Account\n"
LINES = "id string, Date string, Description string, Amount string, Category string, `From Account` string, `To Account` string"
_numbers = itertools.count()
pytestmark = pytest.mark.usefixtures("without_compilation")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"batch{next(_numbers)}", f"{tmp_path}/ledger", AS_OF, keep_mart=True, keep_indexes=True)


def line(id_, day=1):
    return (id_, f"2025-01-{day:02}", "tea", "1", "food", "n26", "home")


def seen(ledger):
    frames = (ledger.expenses(), ledger.fact(), ledger.import_log())
    return [*(f.count() for f in frames), read_kpi(ledger.kept_mart(), "headline").collect()]


#: The writes that readers could see a part of, in order, and the mark at the end.
STEPS = [
    ("write_batch", "expenses_line"),
    ("write_batch", "integrity_file_imported"),
    ("add_facts", None),
    ("write_batch", "mart_batch"),
    ("write_batch", "fact_key"),
    ("drop_batch", "open_batch"),
]


@pytest.fixture(scope="module")
def stopped(spark, tmp_path_factory):
    """One ledger in which a batch is stopped before each of its steps in turn, and then repeated."""
    folder = tmp_path_factory.mktemp("stopped")
    ledger = Ledger(spark, "stopped", f"{folder}/ledger", AS_OF, keep_mart=True, keep_indexes=True)
    (folder / "first.csv").write_text(HEADER + "2025-01-01,tea,1,n26,home\n")
    ledger.import_files([str(folder / "first.csv")], "first")
    (folder / "second.csv").write_text(HEADER + "2025-01-02,bun,2,n26,home\n2024-01-02,bun,4,n26,home\n")
    before = seen(ledger)
    states = {}
    for step, table in STEPS:
        method = getattr(LedgerTables, step)

        def stop(self, *args, method=method, table=table):
            if table is None or args[0] == table:
                raise RuntimeError("stopped")
            return method(self, *args)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(LedgerTables, step, stop)
            with pytest.raises(RuntimeError, match="stopped"):
                ledger.import_files([str(folder / "second.csv")], "second")
        states[step, table] = seen(ledger) == before
    # The last of these has written all but the end, so the period's total reads the facts.
    states["cumulative"] = [r.cumulative_amount for r in ledger.cumulative().collect()] == [1.0]
    ledger.import_files([str(folder / "second.csv")], "second")
    return ledger, states


def test_a_reader_sees_none_of_a_batch_that_has_not_ended(stopped):
    assert stopped[1] == dict.fromkeys([*STEPS, "cumulative"], True)


def test_all_of_it_is_there_at_the_end(stopped):
    ledger, _ = stopped
    assert sorted(r.amount for r in ledger.expenses().collect()) == [1.0, 2.0, 4.0]
    assert ledger.fact().count() == 3 and ledger.import_log().count() == 2
    assert [r.cumulative_amount for r in ledger.cumulative().collect()] == [4.0, 5.0, 7.0]
    assert ledger.tables.batches("open_batch") == set()


def test_ids_by_stored_filters(ledger, frame):
    ledger.insert(frame([line(f"a{k}", k % 28 + 1) for k in range(60)], LINES), "a")
    ledger.insert(frame([line(f"b{k}", k % 28 + 1) for k in range(60)], LINES), "b")
    for bad in (["a7"], ["x", "x"], ["x", None], ["c1", "b59"]):
        with pytest.raises(ValueError, match="missing, repeated or known"):
            ledger.insert(frame([line(i, n + 1) for n, i in enumerate(bad)], LINES))
    ledger.insert(frame([line("c1"), line("c2", 2)], LINES), "c")
    assert ledger.expenses().count() == 122


def test_filters_miss_no_id(frame):
    stored = frame([(f"id-{k}",) for k in range(3000)], "id string")
    other = frame([(f"id-{k}",) for k in range(2500, 2600)], "id string")
    from pyspark.sql import functions as F

    filters = filter_of(stored).withColumn("batch_id", F.lit("one")).unionByName(
        filter_of(other).withColumn("batch_id", F.lit("two"))
    )
    asked = frame([(f"id-{k}",) for k in range(2000, 5000)] + [(None,)], "id string")
    found = {}
    for r in may_be_known(asked, filters).collect():
        found.setdefault(r.batch_id, set()).add(int(r.id[3:]))
    assert found["one"] >= set(range(2000, 3000)) and found["two"] >= set(range(2500, 2600))
    assert len(found["one"]) < 1000 + 100 and len(found["two"]) < 100 + 150


def test_filters_of_nothing(frame):
    nothing = frame([], "id string")
    from pyspark.sql import functions as F

    filters = filter_of(nothing).withColumn("batch_id", F.lit("one"))
    assert may_be_known(frame([("a",)], "id string"), filters).isEmpty()
    assert may_be_known(nothing, filters).isEmpty()

"""The stream's KPIs against those over the whole fact table, with stops and repeats in between."""

import datetime as dt
import itertools

import pytest

from coinbrook.plans import kpis
from coinbrook.plans.ledger import Ledger
from coinbrook.streaming.live_kpis import kpi_stream, live_kpi

AS_OF = dt.datetime(2026, 1, 2)
LINES = "Date string, Description string, Amount string, Category string, `From Account` string, `To Account` string"
_numbers = itertools.count()
pytestmark = pytest.mark.usefixtures("without_compilation")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"live{next(_numbers)}", f"{tmp_path}/ledger", AS_OF)


def rows(n):
    return [(f"2025-0{k % 3 + 1}-01", "x", f"{n}.{k}", ["food", None, "home"][k % 3], "a", "b") for k in range(6)]


def agrees(ledger):
    fact = ledger.fact()
    got = {r.parent_category: r.total for r in live_kpi(ledger, "category").collect()}
    assert got == {r.parent_category: r.expend_amount for r in kpis.total_per_category(fact).collect()}
    months = {(r.year, r.month): r.total for r in live_kpi(ledger, "monthly").collect()}
    assert months == {(r.year, r.month): r.expend_amount for r in kpis.monthly_trend(fact).collect()}


def test_stream_goes_on_after_a_stop(ledger, frame, tmp_path):
    for n in (1, 2):
        ledger.insert(frame(rows(n), LINES).repartition(3))
    query = kpi_stream(ledger, f"{tmp_path}/check", files_per_batch=2)
    query.awaitTermination()
    epochs = len(query.recentProgress)
    assert epochs > 1
    agrees(ledger)
    ledger.insert(frame(rows(3), LINES))
    kpi_stream(ledger, f"{tmp_path}/check").awaitTermination()
    agrees(ledger)
    kpi_stream(ledger, f"{tmp_path}/check").awaitTermination()
    agrees(ledger)


def test_a_failed_micro_batch_is_repeated(ledger, frame, tmp_path, monkeypatch):
    ledger.insert(frame(rows(1), LINES))
    kpi_stream(ledger, f"{tmp_path}/check").awaitTermination()
    ledger.insert(frame(rows(2), LINES))
    swap = type(ledger.tables).swap_live

    def swap_and_fail(self, *args):
        swap(self, *args)
        raise RuntimeError("lost after the swap")

    with monkeypatch.context() as patch:
        patch.setattr(type(ledger.tables), "swap_live", swap_and_fail)
        with pytest.raises(Exception, match="lost after the swap"):
            kpi_stream(ledger, f"{tmp_path}/check").awaitTermination()
    agrees(ledger)
    kpi_stream(ledger, f"{tmp_path}/check").awaitTermination()
    agrees(ledger)


def test_starting_anew(ledger, frame, tmp_path):
    ledger.insert(frame(rows(1), LINES))
    kpi_stream(ledger, f"{tmp_path}/one").awaitTermination()
    ledger.tables.drop_live()
    kpi_stream(ledger, f"{tmp_path}/two").awaitTermination()
    agrees(ledger)


def test_state_is_not_gathered_in_one_task(ledger, frame, tmp_path, monkeypatch):
    """What is stored for readers comes from the stored result of a micro-batch, not from the state."""
    plans, swap = [], ledger.tables.swap_live

    def noted(kpis, epoch):
        plans.append(kpis._jdf.queryExecution().executedPlan().toString())
        swap(kpis, epoch)

    monkeypatch.setattr(ledger.tables, "swap_live", noted)
    ledger.insert(frame(rows(1), LINES))
    kpi_stream(ledger, f"{tmp_path}/check").awaitTermination()
    assert plans and not any("StateStore" in plan for plan in plans)
    agrees(ledger)

"""The maintained mart against KPIs over the whole fact table."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from coinbrook.plans import cells, kpis
from coinbrook.plans.ledger import Ledger
from coinbrook.plans.mart import KPI_KEYS, kpi_mart, read_kpi

AS_OF = dt.datetime(2026, 1, 2)
ROWS = "Date string, Description string, Amount string, Category string, `From Account` string, `To Account` string"
_numbers = itertools.count()
pytestmark = pytest.mark.usefixtures("without_compilation")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"cells{next(_numbers)}", f"{tmp_path}/ledger", AS_OF, keep_mart=True, rows_per_split=8)


def batch(seed, n=40, first=2024):
    rng = random.Random(seed)

    def one():
        date = dt.date(first, 1, 1) + dt.timedelta(days=rng.choice([0, 0, 0, 40, 200, 380]))
        return (
            rng.choice([str(date)] * 9 + [None]),
            "x",
            rng.choice(["0.1", "2.35", "1e12", "7", "3e-7", "0"]),
            rng.choice(["food", "home", None]),
            rng.choice(["n26", "wise"]),
            rng.choice(["shop", None]),
        )

    return [one() for _ in range(n)]


def near(rows):
    def cell(x):
        return round(x, 4) if isinstance(x, float) else x

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


def same_mart(ledger):
    fact, mart = ledger.fact(), ledger.kept_mart()
    columns = ["kpi", *[k for group in KPI_KEYS.values() for k in group], "total", "mean", "transactions"]
    grouped = mart.filter(F.col("kpi").isin(list(KPI_KEYS))).select(*columns)
    assert near(grouped.collect()) == near(kpi_mart(fact).select(*columns).collect())
    whole = kpis.headline(fact).select("total_expenses", "total_transactions", "top_category")
    assert near(read_kpi(mart, "headline").collect()) == near(whole.collect())
    top = [r.expend_amount for r in kpis.highest_expenses(fact).collect()]
    assert sorted(r.total for r in read_kpi(mart, "top").collect()) == sorted(top)
    assert read_kpi(mart, "balances").count() == ledger.accounts().count()
    trend = kpis.cumulative_trend(fact).collect()
    last = {r.expense_date: r.cumulative_amount for r in trend}
    ends = {r.expense_date: r.total for r in read_kpi(mart, "daily").collect()}
    assert near(ends.items()) == near(last.items())
    assert near(ledger.cumulative().collect()) == near(trend)


def test_three_imports_equal_the_full_mart(ledger, frame):
    for seed, first in ((1, 2024), (2, 2025), (3, 2022)):
        ledger.insert(frame(batch(seed, first=first), ROWS), f"b{seed}")
    same_mart(ledger)


def test_a_batch_reads_its_own_rows_only(ledger, frame, monkeypatch):
    ledger.insert(frame(batch(1), ROWS), "b1")
    ledger.rows_per_split = 10**9
    monkeypatch.setattr(Ledger, "fact", lambda self: pytest.fail("the fact table was read"))
    ledger.insert(frame(batch(2), ROWS), "b2")
    plan = cells.mart_cells(ledger._batch_facts("b2"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "batch_id" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "(batch_id" in plan and "b2" in plan


def test_merging_changes_nothing(ledger, frame):
    for seed in (1, 2):
        ledger.insert(frame(batch(seed), ROWS), f"b{seed}")
    before = near(ledger.kept_mart().collect())
    first = ledger.merge_mart()
    assert near(ledger.kept_mart().collect()) == before
    ledger.insert(frame(batch(3, first=2021), ROWS), "b3")
    second = ledger.merge_mart()
    ledger.insert(frame(batch(1), ROWS), "b1")
    same_mart(ledger)
    stored = ledger.tables.batches("mart_cell")
    assert first in stored and second in stored and "b1" not in stored


@pytest.mark.parametrize("broken", ["mart_top", "mart_batch"])
def test_an_interrupted_count_is_repeated(ledger, frame, monkeypatch, broken):
    ledger.insert(frame(batch(1), ROWS), "b1")
    before = near(read_kpi(ledger.kept_mart(), "category").collect())
    write = type(ledger.tables).write_batch

    def fail(self, table, rows, batch_id):
        if table == broken:
            raise RuntimeError("lost")
        write(self, table, rows, batch_id)

    with monkeypatch.context() as patch:
        patch.setattr(type(ledger.tables), "write_batch", fail)
        with pytest.raises(RuntimeError, match="lost"):
            ledger.insert(frame(batch(2), ROWS), "b2")
    assert near(read_kpi(ledger.kept_mart(), "category").collect()) == before
    ledger.insert(frame(batch(2), ROWS), "b2")
    want = read_kpi(kpi_mart(ledger.fact()), "category")
    assert near(read_kpi(ledger.kept_mart(), "category").collect()) == near(want.collect())


def test_catching_up(spark, ledger, frame):
    plain = Ledger(spark, ledger.tables.database, ledger.tables.location, AS_OF)
    plain.insert(frame(batch(5), ROWS), "b5")
    late = Ledger(spark, ledger.tables.database, ledger.tables.location, AS_OF, keep_mart=True, rows_per_split=8)
    want = read_kpi(kpi_mart(late.fact()), "monthly")
    assert near(read_kpi(late.kept_mart(), "monthly").collect()) == near(want.collect())
    assert near(late.cumulative().collect()) == near(kpis.cumulative_trend(late.fact()).collect())


def test_an_empty_ledger(ledger):
    assert ledger.kept_mart().filter("kpi <> 'balances'").isEmpty()
    assert ledger.cumulative().isEmpty()


def test_years_and_periods(ledger, frame):
    for seed in (1, 2):
        ledger.insert(frame(batch(seed), ROWS), f"b{seed}")
    fact = ledger.fact()
    one = read_kpi(ledger.kept_mart([2025]), "category").select("parent_category", "total")
    want = kpis.total_per_category(fact.filter("year = 2025"))
    assert near(one.collect()) == near(want.collect())
    period = ledger.cumulative("2024-02-01", "2024-12-31")
    whole = kpis.cumulative_trend(fact).filter("expense_date between '2024-02-01' and '2024-12-31'")
    assert near(period.collect()) == near(whole.collect()) != []
    plan = period._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(expense_date,2024-02-01)" in plan

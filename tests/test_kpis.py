import datetime as dt
import hashlib
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coinbrook.operators.running_total import running_total
from coinbrook.plans import kpis
from coinbrook.plans.fact import build_fact
from coinbrook.plans.mart import KPI_KEYS, kpi_mart, read_kpi

LINES = "id string, date date, description string, category string, amount double, from_account string, towards string"


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def fact(frame):
    d = dt.date
    rows = [
        ("1", d(2024, 12, 1), "a", "food", 10.0, "n26", "home"),
        ("2", d(2024, 12, 7), "b", "food", None, "n26", "home"),
        ("3", d(2025, 5, 12), "c", "grocery", 30.0, "wise", "home"),
        ("4", None, "d", "green", 5.0, None, "home"),
        ("5", d(2025, 5, 12), "e", None, 2.5, "wise", None),
        ("6", d(2025, 1, 5), "f", "empty", None, "cash", "home"),
        ("7", d(2025, 1, 5), "g", "green", 25.0, "cash", "office"),
    ]
    return build_fact(frame(rows, LINES), dt.datetime(2026, 1, 1))


def test_fact_has_a_row_per_line(fact):
    assert fact.count() == 7
    row = fact.filter("id = '4'").first()
    assert (row.season, row.year, row.month_year_marker) == ("Autumn", None, None)
    assert (row.currency, row.category_tag) == ("EUR", None)
    assert row.booked_date == dt.date(2026, 1, 1)


def test_category_total_and_order(fact):
    assert tuples(kpis.total_per_category(fact)) == [
        ("green", 30.0),
        ("grocery", 30.0),
        ("food", 10.0),
        ("empty", 0.0),
    ]


def test_category_filters(fact):
    def total(**filters):
        return dict(tuples(kpis.total_per_category(fact, **filters)))

    assert total(filter_category=[]) == total()
    assert total(filter_category=["food"]) == {"food": 10.0}
    assert total(filter_start_date="2025-05-12") == {"grocery": 30.0}
    assert total(filter_start_date="2025-05-12 00:00:01") == {}
    assert total(filter_end_date="2024-12-01") == {"food": 10.0}
    assert total(filter_end_date=dt.datetime(2024, 12, 1, 8)) == {"food": 10.0}
    assert total(filter_start_date=dt.date(2025, 1, 1), filter_end_date="2025-01-31") == {
        "green": 25.0,
        "empty": 0.0,
    }


def test_monthly(fact):
    assert tuples(kpis.monthly_trend(fact)) == [
        (2024, 12, "Dec-24", 10.0),
        (2025, 1, "Jan-25", 25.0),
        (2025, 5, "May-25", 32.5),
    ]


def test_weekday(fact):
    assert tuples(kpis.weekday_average(fact)) == [
        (0, "Sunday", 17.5),
        (1, "Monday", 16.25),
        (6, "Saturday", None),
    ]


def test_other_sums(fact):
    assert tuples(kpis.seasonal_breakdown(fact)) == [
        ("Winter", 35.0),
        ("Spring", 32.5),
        ("Autumn", 5.0),
    ]
    assert tuples(kpis.account_summary(fact)) == [("wise", 32.5), ("cash", 25.0), ("n26", 10.0)]
    assert tuples(kpis.towards_analysis(fact)) == [("home", 45.0), ("office", 25.0)]
    assert tuples(kpis.category_tag_insights(fact)) == []


def test_headline(fact):
    assert tuples(kpis.headline(fact)) == [(72.5, 7, "green")]
    assert tuples(kpis.headline(fact.limit(0))) == []
    assert tuples(kpis.headline(fact.filter("id = '5'"))) == [(2.5, 1, None)]


def test_highest(frame):
    rows = [(str(i), None, None, None, v, None, None) for i, v in enumerate([5.0, 9.0, 9.0, 9.0])]
    rows += [("x", None, None, None, float("nan"), None, None), ("y",) + (None,) * 6]
    fact = build_fact(frame(rows, LINES)).withColumn("description", F.col("id"))
    assert [r.description for r in kpis.highest_expenses(fact, 2).collect()] == ["1", "2"]
    got = [r.description for r in kpis.highest_expenses(fact, 10).collect()]
    assert got[:4] == ["1", "2", "3", "0"] and set(got[4:]) == {"x", "y"}


def test_balances(frame):
    rows = [("a", "t", 1.0, "EUR"), ("b", "t", None, "EUR"), ("c", "t", 7.0, "INR")]
    accounts = frame(rows, "name string, type string, current_balance double, currency string")
    assert [r.name for r in kpis.account_balances(accounts).collect()] == ["c", "a", "b"]


def test_cumulative(fact):
    got = tuples(kpis.cumulative_trend(fact))
    days = [r[0] for r in got]
    assert days == sorted(days[:-1]) + [None]
    assert got[0] == (dt.date(2024, 12, 1), 10.0)
    assert got[1] == (dt.date(2024, 12, 7), None)
    assert got[-1] == (None, 72.5)


@pytest.mark.parametrize("rows_per_split", [1, 3, 50, 10**6])
def test_running_total_with_a_busy_day(spark, rows_per_split):
    """A third of all rows on one day, many without a day, in many or few splits."""
    pick = random.Random(7)
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=n) for n in range(5)]
    values = [None, float("nan"), 1.25, -3.5, 100.0, 2e12, 0.01]
    rows = []
    for n in range(600):
        day = days[2] if n % 3 == 0 else pick.choice([*days, None])
        rows.append((f"id{n % 550}", day, pick.choice(values)))
    df = spark.createDataFrame(rows, "id string, day date, v double").repartition(7)
    got = running_total(df, "day", "id", "v", "total", rows_per_split).collect()

    def place(r):
        value = r[2]
        rank = (0, 0) if value is None else (2, 0) if math.isnan(value) else (1, value)
        tie = hashlib.md5(r[0].encode()).hexdigest()
        return (r[1] is None, r[1] or dt.date.min, tie, r[0], rank)

    total, expected = Decimal(0), []
    for id_, day, value in sorted(rows, key=place):
        known = value is not None and not math.isnan(value)
        total += Decimal(str(value)) if known else 0
        expected.append((id_, day, float(total) if known else None))
    assert len(got) == len(expected)
    for row, (id_, day, want) in zip(got, expected):
        assert (row["id"], row["day"]) == (id_, day)
        assert row["total"] == (pytest.approx(want, abs=0.3) if want is not None else None)


def test_running_total_plan_has_one_shuffle_of_the_rows(fact):
    """The window reads the range-partitioned rows as they are; only days go to one task."""
    total = kpis.cumulative_trend(fact)
    plan = total._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Window")[1].split("BroadcastHashJoin")[0]
    assert top.count("Exchange") == 1 and "rangepartitioning" in top


def test_filters_reach_the_scan(spark, fact, tmp_path):
    fact.write.partitionBy("year").parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    total = kpis.total_per_category(stored, filter_start_date="2025-01-01")
    plan = total._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(expense_date,2025-01-01)" in plan
    assert "year#" in plan.split("PartitionFilters")[1].split("]")[0]
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "description" not in read and "expend_amount" in read


def test_mart_equals_the_kpis(spark, fact, tmp_path):
    kpi_mart(fact).write.partitionBy("kpi").parquet(str(tmp_path / "mart"))
    mart = spark.read.parquet(str(tmp_path / "mart"))
    single = {
        "category": kpis.total_per_category(fact),
        "monthly": kpis.monthly_trend(fact),
        "season": kpis.seasonal_breakdown(fact),
        "account": kpis.account_summary(fact),
        "tag": kpis.category_tag_insights(fact),
        "towards": kpis.towards_analysis(fact),
    }
    for name, kpi in single.items():
        got = read_kpi(mart, name).select(*KPI_KEYS[name], "total")
        assert sorted(tuples(got)) == sorted(tuples(kpi)), name
    weekday = read_kpi(mart, "weekday").select(*KPI_KEYS["weekday"], "mean")
    assert sorted(tuples(weekday)) == sorted(tuples(kpis.weekday_average(fact)))


def test_mart_reads_the_fact_once(fact):
    plan = kpi_mart(fact)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1


def test_totals_agree(fact):
    by_category = sum(r[1] for r in kpis.total_per_category(fact).collect())
    without = fact.filter("parent_category is null").agg(F.sum("expend_amount")).first()[0]
    assert by_category + without == kpis.headline(fact).first()["total_expenses"]


def test_filter_dates_in_other_spellings():
    from coinbrook.plans.kpis import _moment

    for text in ("2025-1-2", "01/02/2025", "2025/01/02", "20250102", "2 Jan 2025", "Jan 2, 2025", "2025-01-02T00:00:00"):
        assert _moment(text) == dt.datetime(2025, 1, 2), text
    with pytest.raises(ValueError):
        _moment("soon")

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from coinbrook.functions import amounts, dates, text


def one_column(frame, values, expression):
    rows = frame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_coerce_amount(frame):
    good = {" 1 ": 1, "1e3": 1000, "+3": 3, "1.": 1, "-5": -5, ".5": 0.5, "\t7\n": 7}
    assert one_column(frame, good, amounts.coerce_amount) == list(good.values())
    infinite = one_column(frame, ["inf", "Infinity", "-inf", "+INF"], amounts.coerce_amount)
    assert infinite == [math.inf, math.inf, -math.inf, math.inf]
    bad = ["nan", "NaN", "1d", "1F", "1,000", "", "abc", None, "0x10", "1_000", "1e400", "1 2"]
    assert one_column(frame, bad, amounts.coerce_amount) == [0.0] * len(bad)


def test_parse_amount_of_numbers(frame):
    rows = frame([(1.5,), (float("nan"),), (None,), (1e20,)], "v double")
    got = [r[0] for r in rows.select(amounts.parse_amount(F.col("v"))).collect()]
    assert got == [1.5, None, None, 1e20]


def test_money_sum(frame):
    def total(values):
        rows = frame([(v,) for v in values], "v double")
        return rows.agg(amounts.money_sum(F.col("v"))).first()[0]

    assert total([0.1] * 10) == 1.0
    assert total([None, float("nan")]) == 0.0
    assert total([1.0, float("nan"), 2.0]) == 3.0
    assert total([-0.1] * 3 + [0.000001]) == -0.299999
    assert total([999_999_999.999999] * 1000) == 999_999_999_999.999
    assert total([1e9, 0.25, -1e9]) == 0.25
    assert total([1e15, 0.25]) == 1e15 + 0.25
    assert total([1.0, math.inf]) == math.inf
    assert math.isnan(total([math.inf, -math.inf]))


def test_money_mean(frame):
    rows = frame([(1.0,), (None,), (2.0,), (float("nan"),)], "v double")
    assert rows.agg(amounts.money_mean(F.col("v"))).first()[0] == 1.5
    assert rows.filter("v is null").agg(amounts.money_mean(F.col("v"))).first()[0] is None


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2025-01-02", (2025, 1, 2)),
        ("2025-1-2", (2025, 1, 2)),
        ("2025-01-02 10:11:12", (2025, 1, 2)),
        ("2025-01-02 10:11:12.5", (2025, 1, 2)),
        ("2025-01-02T10:11", (2025, 1, 2)),
        ("2025/3/4", (2025, 3, 4)),
        ("02/03/2025", (2025, 2, 3)),
        ("20250102", (2025, 1, 2)),
        ("2 Jan 2025", (2025, 1, 2)),
        ("Jan 2, 2025", (2025, 1, 2)),
        ("2025-02-30", None),
        ("2025-01-02x", None),
        ("2025-01-02 25:00", None),
        ("2025-01-02\n", None),
        ("2025", None),
        ("hello", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(frame, value, expected):
    expected = expected and dt.date(*expected)
    assert one_column(frame, [value], dates.parse_date) == [expected]


def test_parse_iso_date(frame):
    values = ["2026-05-10", "2026-5-1", "2026/05/10", "2026-05-10 10:00", "", None]
    expected = [dt.date(2026, 5, 10), dt.date(2026, 5, 1), None, None, None, None]
    assert one_column(frame, values, dates.parse_iso_date) == expected


def test_parse_date_with_other_formats(frame):
    got = one_column(frame, ["31.12.2025", "2025-12-31"], lambda c: dates.parse_date(c, ["d.M.yyyy"]))
    assert got == [dt.date(2025, 12, 31), None]


@pytest.mark.parametrize(
    "date, expected",
    [
        (dt.date(2024, 12, 1), (1, 12, 2024, 202412, "Dec-24", 0, "Sunday", "Winter")),
        (dt.date(2024, 12, 7), (7, 12, 2024, 202412, "Dec-24", 6, "Saturday", "Winter")),
        (dt.date(2025, 5, 12), (12, 5, 2025, 202505, "May-25", 1, "Monday", "Spring")),
        (dt.date(2005, 8, 31), (31, 8, 2005, 200508, "Aug-05", 3, "Wednesday", "Summer")),
        (None, (None,) * 7 + ("Autumn",)),
    ],
)
def test_calendar_columns(frame, date, expected):
    rows = frame([(date,)], "d date")
    columns = [c.alias(n) for n, c in dates.calendar_columns("d").items()]
    assert tuple(rows.select(*columns).first()) == expected


def test_calendar_names_equal_the_formatter(spark):
    days = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2024-12-31')) AS d")
    names = dates.calendar_columns("d")
    wrong = days.filter(
        (names["month_year_marker"] != F.date_format("d", "MMM-yy"))
        | (names["day_of_week"] != F.date_format("d", "EEEE"))
    )
    assert wrong.count() == 0


def test_is_blank(frame):
    blank = [None, "", " ", "\t\n", " ", "　 "]
    assert one_column(frame, blank, text.is_blank) == [True] * len(blank)
    assert one_column(frame, ["a", " a ", "-"], text.is_blank) == [False] * 3


def test_prohibited_symbols(frame):
    for symbol in map(chr, range(32, 127)):
        expected = symbol in text.PROHIBITED_SYMBOLS
        assert one_column(frame, [f"a{symbol}b"], text.has_prohibited_symbol) == [expected], symbol
        if symbol == "/":
            break
    assert one_column(frame, ["x_y", "it's", "a;b", "(a)"], text.has_prohibited_symbol) == [
        False,
        False,
        False,
        True,
    ]


def test_na_tokens(frame):
    assert one_column(frame, text.NA_TOKENS, text.na_to_null) == [None] * 19
    assert one_column(frame, ["NAN", "none", " NA"], text.na_to_null) == ["NAN", "none", " NA"]


def test_sums_drop_nothing(frame):
    tiny = frame([(4e-7,)] * 1000, "v double")
    total, mean = tiny.agg(amounts.money_sum(F.col("v")), amounts.money_mean(F.col("v"))).first()
    assert total == pytest.approx(0.0004, rel=1e-12) and mean == pytest.approx(4e-7, rel=1e-12)
    mixed = frame([(4e-7,), (0.1,), (0.2,), (1 / 3,), (2.5e9,), (None,), (float("nan"),)], "v double")
    assert mixed.agg(amounts.money_sum(F.col("v"))).first()[0] == pytest.approx(2.5e9 + 0.3 + 1 / 3 + 4e-7, rel=1e-15)
    money = frame([(k / 100,) for k in range(1, 2000)], "v double")
    assert money.agg(amounts.money_sum(F.col("v"))).first()[0] == 19990.0

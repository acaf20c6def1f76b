import csv
import io
import random

import pytest

from coinbrook.functions.text import NA_TOKENS
from coinbrook.operators.validation import check_file_rows
from coinbrook.sources.csv_files import file_frame, find_files, read_csv, read_files
from coinbrook.sources.csv_records import read_records
from coinbrook.sources.csv_records import read_records

HEADER = "Date,Description,Amount,From Account,To Account\n"


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(path)


def load(spark, folder):
    found = find_files(spark, [str(folder)])
    return found, read_files(spark, found)


def by_name(found):
    return {f.filename: f for f in found}


def test_headers_in_any_order(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER + "2025-01-01,tea,1.5,n26,home\n")
    write(
        tmp_path,
        "b.csv",
        "id,Amount,DATE,towards,from account,Category,description,Note\n"
        "7,2,2025-01-02,office,wise,food,bun,hi\n",
    )
    found, rows = load(spark, tmp_path)
    assert [f.filename for f in found] == ["a.csv", "b.csv"]
    got = {r.file.rsplit("/", 1)[-1]: r for r in rows.collect()}
    a, b = got["a.csv"], got["b.csv"]
    assert (a.date, a.description, a.amount, a.from_account, a.towards) == (
        "2025-01-01", "tea", "1.5", "n26", "home",
    )
    assert (a.id, a.has_id, a.category, a.has_category) == (None, False, None, False)
    assert (b.id, b.date, b.description, b.amount, b.from_account, b.towards, b.category) == (
        "7", "2025-01-02", "bun", "2", "wise", "office", "food",
    )
    assert b.has_id and b.has_category


def test_na_tokens_become_null(spark, tmp_path):
    lines = "".join(f'2025-01-01,"{t}",1,n26,home\n' for t in NA_TOKENS)
    write(tmp_path, "a.csv", HEADER + lines + "2025-01-01,,1,n26,home\n2025-01-01,Nan,1,n26,home\n")
    got = [r.description for r in load(spark, tmp_path)[1].collect()]
    assert got.count(None) == 20 and got.count("Nan") == 1


def test_quotes_and_line_breaks(spark, tmp_path):
    content = (
        HEADER
        + '2025-01-01,"say ""hi"", now",1,n26,home\n'
        + '2025-01-01,"two\nlines",2,n26,home\n'
        + '2025-01-01,5" pipe,3,n26,home\n'
    )
    write(tmp_path, "broken.csv", content)
    write(tmp_path, "plain.csv", HEADER + '2025-01-01,"a ""b"" c",1,n26,home\n2025-01-01,5" x,1,n26,y\n')
    found, rows = load(spark, tmp_path)
    assert by_name(found)["broken.csv"].line_breaks_in_cells
    assert not by_name(found)["plain.csv"].line_breaks_in_cells
    got = {r.description for r in rows.collect()}
    assert got == {'say "hi", now', "two\nlines", '5" pipe', 'a "b" c', '5" x'}


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def default_splits(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [16, 100, 10**8])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_line_breaks_in_split_files(spark, tmp_path, default_splits, size, line_end):
    """Cells with line breaks, quotes and commas, in splits that cut through cells and records."""
    pick = random.Random(size)
    pieces = ["a", "b c", ",", '"', "\n", ' "', "x,y", "\n\n", '"\n"', ""]
    expected = []
    for number in range(3):
        rows = [
            ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 6))) or "z" for _ in range(5)]
            for _ in range(40)
        ]
        # A stray quote inside an unquoted cell opens nothing.
        buffer = io.StringIO()
        writer = csv.writer(buffer, lineterminator=line_end)
        writer.writerow(["Date", "Description", "Amount", "From Account", "To Account"])
        writer.writerows(rows)
        buffer.write(f'5" pipe,q"r,1,n26,"last\ncell"{line_end}{line_end}')
        rows.append(['5" pipe', 'q"r', "1", "n26", "last\ncell"])
        (tmp_path / f"f{number}.csv").write_bytes(buffer.getvalue().encode())
        expected += [(f"f{number}.csv", *row) for row in rows]
    small_splits(spark, size)
    found, rows = load(spark, tmp_path)
    assert all(f.line_breaks_in_cells for f in found)
    names = {f.file: f.filename for f in found}
    got = [
        (names[r.file], r.date, r.description, r.amount, r.from_account, r.towards)
        for r in rows.collect()
    ]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_a_quote_that_never_closes(spark, tmp_path, default_splits, size):
    """The lines behind it are not gathered; the file is told apart, and the others are read."""
    rest = "".join(f"2025-01-03,tail {k},1,n26,home\n" for k in range(200))
    write(tmp_path, "open.csv", HEADER + '2025-01-01,"two\nlines",1,n26,home\n2025-01-02,"never closed,1,n26,home\n' + rest)
    write(tmp_path, "last.csv", HEADER + '2025-01-01,tea,1,n26,"home\n')
    write(tmp_path, "sound.csv", HEADER + '2025-01-01,"two\nlines",1,n26,home\n')
    found = find_files(spark, [str(tmp_path)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    records = [(r.file.rsplit("/", 1)[-1], r.record, r.unclosed) for r in read_records(spark, [f.path for f in found]).collect()]
    assert sorted(records) == [
        ("last.csv", '2025-01-01,tea,1,n26,"home', True),
        ("open.csv", '2025-01-01,"two\nlines",1,n26,home', False),
        ("open.csv", '2025-01-02,"never closed,1,n26,home', True),
        ("sound.csv", '2025-01-01,"two\nlines",1,n26,home', False),
    ]
    rows = read_files(spark, found)
    report = check_file_rows(rows, ["file"]).collect()
    assert {r.file.rsplit("/", 1)[-1]: r.overlong_rows for r in report} == {"open.csv": 1, "last.csv": 1, "sound.csv": 0}
    with pytest.raises(Exception, match="open at the end"):
        read_csv(spark, str(tmp_path / "open.csv")).count()


def test_odd_files(spark, tmp_path):
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "header only.csv", HEADER)
    write(tmp_path, "bom.csv", ("﻿" + HEADER + "2025-01-01,a,1,n26,home\n").encode())
    write(tmp_path, "short.csv", "Date,Amount\n2025-01-01,1\n")
    write(tmp_path, "long.csv", HEADER + "2025-01-01,a,1,n26,home,more\n2025-01-01,b,1,n26,home\n")
    write(tmp_path, "odd [1] é.csv", HEADER + "2025-01-01,odd,1,n26,home\n")
    found, rows = load(spark, tmp_path)
    files = {r.filename: r.missing_columns for r in file_frame(spark, found).collect()}
    assert files["empty.csv"] == ["date", "description", "amount", "from_account", "towards"]
    assert files["header only.csv"] == [] and files["bom.csv"] == []
    assert files["short.csv"] == ["description", "from_account", "towards"]
    keys = {f.file: f.filename for f in found}
    got = [(keys[r.file], r.description, r.extra_fields) for r in rows.collect()]
    assert sorted(got, key=str) == [
        ("bom.csv", "a", None),
        ("long.csv", "a", "more"),
        ("long.csv", "b", None),
        ("odd [1] é.csv", "odd", None),
        ("short.csv", None, None),
    ]


def test_a_plain_file_is_split_over_tasks(spark, tmp_path, default_splits):
    write(tmp_path, "a.csv", HEADER + "2025-01-01,some words,1,n26,home\n" * 20000)
    small_splits(spark, 100000)
    found, rows = load(spark, tmp_path)
    assert rows.rdd.getNumPartitions() > 4
    assert rows.count() == 20000
    assert rows.filter("description = 'some words'").count() == 20000


def test_read_csv_keeps_the_header(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEADER + '2025-01-01,"a\nb",NA,n26,home\n')
    rows = read_csv(spark, path)
    assert rows.columns == ["Date", "Description", "Amount", "From Account", "To Account"]
    assert tuple(rows.first()) == ("2025-01-01", "a\nb", None, "n26", "home")


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_text_of_whole_records_is_shuffled_once(spark, tmp_path):
    """Records within one block are put together where they were read; no window over lines follows."""
    write(tmp_path, "a.csv", 'a,b\n1,"x\ny"\n2,z\n')
    plan = read_records(spark, [str(tmp_path / "a.csv")])
    assert sorted(r.record for r in plan.collect()) == ['1,"x\ny"', "2,z"]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Window [" in line and "line#" in line]

"""Checks against history by key buckets and by name postings, against the plain lookups."""

import datetime as dt
import itertools
import random

import pytest

from coinbrook.operators.duplicates import ROW_KEY, matching_facts, with_submission_key
from coinbrook.operators.file_names import find_logged
from coinbrook.operators.gates import LOG_ORDER
from coinbrook.operators.key_history import key_text, keys_of, matching_keys
from coinbrook.operators.name_index import find_indexed, postings
from coinbrook.plans.fact import build_fact
from coinbrook.plans.ledger import Ledger

AS_OF = dt.datetime(2026, 1, 2)
FORM = (
    "entry int, Description string, Date string, Amount string, Category string, "
    "`From Account` string, `To Account` string"
)
LOG = "id string, ts timestamp, filename string, date_imported string, no_of_rows_imported int"
_numbers = itertools.count()
pytestmark = pytest.mark.usefixtures("without_compilation")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"indexed{next(_numbers)}", f"{tmp_path}/ledger", AS_OF, keep_indexes=True, key_buckets=4)


def entries(seed, n=60):
    rng = random.Random(seed)
    words = ["tea", "Tea", "1:x", "x", "", None]
    return [
        (
            i,
            rng.choice(words),
            rng.choice(["2025-01-01", "2025-01-02", None]),
            rng.choice(["1", "1.0", "0", "-0.0", "2.5", "abc"]),
            rng.choice(["food", "1:food", None]),
            rng.choice(["n26", "n2"]),
            rng.choice(["home", "6home"]),
        )
        for i in range(n)
    ]


def plain(frame):
    return sorted(((tuple(r[k] for k in ROW_KEY), r["duplicate_of"]["id"]) for r in frame.collect()), key=repr)


def test_keys_match_as_facts_do(spark, ledger, frame):
    for seed in (1, 2):
        ledger.insert(frame([r for r in entries(seed) if r[3] != "abc"], FORM), f"b{seed}")
    asked = with_submission_key(frame(entries(3, 200), FORM))
    found = plain(matching_keys(asked, ledger.tables.read("fact_key")))
    assert found == plain(matching_facts(asked, ledger.fact())) != []


def test_key_texts_differ_where_keys_do(frame):
    rows = [("a", "1:b"), ("a1:", "b"), ("", "x"), ("x", "")]
    own = frame([(None, d, None, c) for d, c in rows], "d string, key_description string, x string, key_category string")
    own = own.selectExpr(
        "date'2025-01-01' as key_date", "key_description", "1.0d as key_amount", "key_category", "'f' as key_from", "'t' as key_towards"
    )
    assert own.select(key_text()).distinct().count() == len(rows)


def test_the_history_is_not_shuffled(spark, ledger, frame):
    ledger.insert(frame(entries(1), FORM), "b1")
    asked = with_submission_key(frame(entries(2), FORM))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ledger.tables.read("fact_key").join(asked.select(key_text().alias("key_text")).distinct(), "key_text")
        plan = matching_keys(asked, ledger.tables.read("fact_key"))._jdf.queryExecution().executedPlan().toString()
        assert joined.count() >= 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    history = plan[plan.index("SortMergeJoin") :].split("\n")
    above = itertools.takewhile(lambda line: "fact_key" not in line, history)
    assert not any("Exchange" in line for line in above)


def test_submissions_by_index_equal_those_by_fact(spark, ledger, frame, tmp_path):
    other = Ledger(spark, f"indexed{next(_numbers)}", f"{tmp_path}/other", AS_OF)
    for seed in (4, 5):
        rows = frame([(i, d or "tea", t or "2025-01-03", a, c or "food", f, to) for i, d, t, a, c, f, to in entries(seed)], FORM)
        reports = [
            sorted((r.entry, r.status, r.error_reason, r.duplicate_of is None) for r in one.submit_rows(rows, f"s{seed}").collect())
            for one in (ledger, other)
        ]
        assert reports[0] == reports[1]
    assert ledger.fact().count() == other.fact().count()


NAMES = ["data.csv", "x_data.csv", "a_b.csv", "axb.csv", "ab", "a", "_", "%", "a%v", "menu_7.csv", "7.csv", "", "a\\q.csv", "Data.csv", "日本語.csv"]


def test_names_by_postings(frame):
    rng = random.Random(7)
    logged = NAMES + ["".join(rng.choice("ab_.7") for _ in range(rng.randint(0, 7))) for _ in range(60)] + [None]
    log = frame([(f"i{k}", AS_OF, n, "2026-01-02", 1) for k, n in enumerate(logged)], LOG)
    asked = sorted({n for n in NAMES + ["".join(rng.choice("ab_%.7") for _ in range(rng.randint(0, 5))) for _ in range(80)]})
    names = frame([(n,) for n in asked] * 2, "filename string")
    by_scan = find_logged(names, log, LOG_ORDER).collect()
    by_index = find_indexed(names, postings(log, LOG_ORDER)).collect()
    assert sorted(by_scan, key=repr) == sorted(by_index, key=repr)
    assert any(r.hit for r in by_index) and not all(r.hit for r in by_index)


def test_only_partitions_of_the_names_are_read(ledger, frame):
    log = frame([(f"i{k}", AS_OF, f"file_{k}.csv", "2026-01-02", 1) for k in range(50)], LOG)
    ledger.tables.write_batch("integrity_file_imported", log, "b")
    ledger._index_names("b")
    found = find_indexed(frame([("le_7.",)], "filename string"), ledger.tables.read("log_gram"))
    assert [r.hit.filename for r in found.collect()] == ["file_7.csv"]
    files = {f.split("part=")[1].split("/")[0] for f in found.inputFiles() if "log_gram" in f}
    assert len(files) <= 3


def test_import_by_index(spark, ledger, frame):
    rows = frame([(1, "tea", "2025-01-01", "1", "food", "n26", "home")], FORM)
    assert ledger.import_frame(rows, "x_data.csv").first().status == "accepted"
    assert ledger.import_frame(rows, "data.csv").first().status == "already imported"
    plain_one = Ledger(spark, ledger.tables.database, ledger.tables.location, AS_OF)
    assert plain_one.import_frame(rows, "new.csv").first().status == "accepted"
    again = Ledger(spark, ledger.tables.database, ledger.tables.location, AS_OF, keep_indexes=True)
    assert again.import_frame(rows, "ew.c").first().status == "already imported"


def test_copies_collapse_in_the_history(frame):
    fact = build_fact(
        frame([(f"i{k}", dt.date(2025, 1, 1), "x", "c", 1.0, "f", "t") for k in range(9)],
              "id string, date date, description string, category string, amount double, from_account string, towards string"),
        AS_OF,
    )
    assert [r.record.id for r in keys_of(fact, 3).collect()] == ["i0"]


def test_names_with_a_common_run_meet_its_logged_names_once(frame):
    """No join of each name with all logged names of its run."""
    logged = [(f"l{n}", None, f"menu_{n}.csv", None, 1) for n in range(40)]
    index = postings(frame(logged, LOG), LOG_ORDER)
    names = frame([(f"u_{n}.csv",) for n in range(30, 50)], "filename string")
    found = find_indexed(names, index)
    plain_hits = find_logged(names, frame(logged, LOG), LOG_ORDER)
    got = {r.filename: r.hit and r.hit.id for r in found.collect()}
    assert got == {r.filename: r.hit and r.hit.id for r in plain_hits.collect()}
    assert got["u_31.csv"] == "l31" and got["u_45.csv"] is None
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Join Inner" in line and "gram#" in line]

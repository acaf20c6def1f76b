import random
import re

import pytest

from coinbrook.operators.file_names import find_logged

pytestmark = pytest.mark.usefixtures("without_compilation")


def like(logged: str, name: str) -> bool:
    pattern = "".join(
        ".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{name}%"
    )
    return re.fullmatch(pattern, logged, re.DOTALL) is not None


def hits(frame, names, logged, match="contains"):
    log = frame([(i, n) for i, n in enumerate(logged)], "id int, filename string")
    found = find_logged(frame([(n,) for n in names], "filename string"), log, ["id"], match)
    return {r.filename: r.hit and r.hit.id for r in found.collect()}


def test_examples(frame):
    logged = ["x_data.csv", "axb.csv", "a\\q.csv"]
    names = ["data.csv", "a_b.csv", "DATA.csv", "a\\q.csv", "b\\q.csv", "axb.csv", "%b.csv", "x%v"]
    assert hits(frame, names, logged) == {
        "data.csv": 0,
        "a_b.csv": 1,
        "DATA.csv": None,
        "a\\q.csv": 2,
        "b\\q.csv": None,
        "axb.csv": 1,
        "%b.csv": 1,
        "x%v": 0,
    }
    exact = hits(frame, names, logged, "exact")
    assert exact == {n: logged.index(n) if n in logged else None for n in names}


def test_no_names_and_no_log(frame):
    assert hits(frame, [], ["a"]) == {}
    assert hits(frame, ["a"], []) == {"a": None}


def test_unknown_rule(frame):
    with pytest.raises(ValueError, match="match"):
        hits(frame, ["a"], ["a"], "fuzzy")


@pytest.mark.parametrize("count, longest", [(120, 4), (2000, 12)])
def test_same_as_brute_force(frame, count, longest):
    pick = random.Random(3)

    def name(alphabet, longest):
        return "".join(pick.choice(alphabet) for _ in range(pick.randint(1, longest)))

    logged = [name("ab_%.", longest * 2) for _ in range(60)]
    names = sorted({name("ab_%.", longest) for _ in range(count)})
    expected = {
        n: next((i for i, entry in enumerate(logged) if like(entry, n)), None) for n in names
    }
    assert hits(frame, names, logged) == expected
    assert None in expected.values()


def test_the_plan_does_not_grow_with_the_names(frame):
    log = frame([(1, "a.csv")], "id int, filename string")

    def plan(names):
        found = find_logged(frame([(n,) for n in names], "filename string"), log, ["id"])
        return re.sub("#[0-9]+|[0-9]+", "", found._jdf.queryExecution().optimizedPlan().toString())

    many = plan([f"a{'_' * (k % 7)}b{k}_.csv" for k in range(300)])
    assert len(many) < 1.2 * len(plan(["a_b.csv", "c.csv"]))


def test_there_is_no_nested_loop(frame):
    log = frame([(1, "a.csv")], "id int, filename string")
    found = find_logged(frame([("a",)], "filename string"), log, ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

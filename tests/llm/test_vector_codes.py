"""Codes of vectors against plain Lloyd rounds that compare every vector with every entry."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coinbrook.llm import cover_tree as ct
from coinbrook.llm import vector_codes as vc


def plain(rows, parts, entries, rounds, scale):
    """(id, code, error) of each row, and the codebooks."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [math.floor(scale * x) for x in v]) for i, v in good]
    if not points:
        return [], [[] for _ in range(parts)]
    dim = len(points[0][1])
    bounds = [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]
    points.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    books = [[p[b:e] for _, p in points[:entries]] for b, e in bounds]

    def best(x, book):
        return min((sum((a - c) ** 2 for a, c in zip(x, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        for k, (b, e) in enumerate(bounds):
            own = {}
            for _, p in points:
                own.setdefault(best(p[b:e], books[k])[1], []).append(p[b:e])
            for j, members in own.items():
                books[k][j] = [sum(c) // len(members) for c in zip(*members)]
    coded = []
    for i, p in points:
        found = [best(p[b:e], book) for (b, e), book in zip(bounds, books)]
        coded.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return coded, books


def vectors(count, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(count)]


CASES = {
    "spread": vectors(300, 16, 1),
    "close groups": vectors(300, 16, 2, 0.01),
    "ties on a grid": [(i, [float((i * 7 + k) % 3) for k in range(8)]) for i in range(120)],
    "one vector": [(i, [0.25] * 8) for i in range(90)],
    "fewer than entries": vectors(3, 8, 3),
    "repeated and null ids": [(i % 4 if i % 5 else None, v) for i, v in vectors(60, 8, 4)],
    "faulty": [(0, None), (1, [1.0, None]), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, [1.0, 2.0]), (5, [-1.5, 2.0])],
    "none": [],
    "large": [(i, [x * 10_000 for x in v]) for i, v in vectors(60, 8, 5)],
    "uneven parts": vectors(60, 13, 6),
}


@pytest.mark.parametrize("name", list(CASES))
def test_equals_plain_rounds(spark, name):
    rows = CASES[name]
    shape = {"parts": 4, "entries": 6, "rounds": 3, "scale": 64}
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    coded, books = vc.compress(frame, block=50, **shape)
    got = sorted(((r["row"]["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=repr)
    want, want_books = plain(rows, **shape)
    assert got == sorted(want, key=repr)
    assert books == want_books


def test_label_errors_and_clashing_names(spark):
    rows = [(i, v, None if i % 3 else i % 2, 1, 2, 3) for i, v in vectors(40, 8, 7)]
    names = "vec_id int, embedding array<float>, label int, error int, row int, of_label int"
    coded, _ = vc.compress(spark.createDataFrame(rows, names))
    found = vc.with_label_error(coded, "label").collect()
    totals = {}
    for r in found:
        totals[r["row"]["label"]] = totals.get(r["row"]["label"], 0) + r["error"]
    assert len(found) == 40 and set(totals) == {None, 0, 1}
    assert all(r["label_error"] == totals[r["row"]["label"]] for r in found)
    assert sorted(tuple(r["row"])[3:] for r in found) == [(1, 2, 3)] * 40


def test_other_lengths_are_left_out(spark):
    rows = [(0, [1.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [])]
    coded, books = vc.compress(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), parts=2)
    assert sorted(r["row"]["vec_id"] for r in coded.collect()) == [1, 2]
    assert books == [[[4096], [12288]], [[8192], [16384]]]


POINTS = st.integers(1, 6).flatmap(
    lambda dim: st.tuples(
        st.lists(st.lists(st.integers(-40, 40), min_size=dim, max_size=dim), min_size=1, max_size=120),
        st.lists(st.lists(st.integers(-40, 40), min_size=dim, max_size=dim), min_size=1, max_size=9),
    )
)


@given(POINTS)
@settings(max_examples=300, deadline=None)
def test_tree_covers_and_assigns(drawn):
    points, entries = np.array(drawn[0], np.int32), np.array(drawn[1], np.int64)
    order, nodes = ct.build(points, leaf=2)
    assert sorted(order.tolist()) == list(range(len(points)))
    placed = points[order]
    for node in nodes:
        own = placed[node["begin"] : node["end"]].astype(float)
        away = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
        assert away.max() == pytest.approx(node["radius"])
        children = nodes[node["child"] : node["last"]]
        assert [c["end"] for c in children[:-1]] == [c["begin"] for c in children[1:]]
        for k, child in enumerate(children):
            assert child["radius"] <= node["radius"] / 2
            for other in children[:k]:
                apart = placed[child["begin"]].astype(float) - placed[other["begin"]]
                assert np.sqrt((apart**2).sum()) > node["radius"] / 2
    found, whole = ct.assign(placed, nodes, entries)
    want = ((placed[:, None].astype(int) - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert found.tolist() == want.tolist()
    count, total = ct.sums(placed, found, len(entries))
    for j in range(len(entries)):
        assert count[j] == (want == j).sum() and total[j].tolist() == placed[want == j].sum(axis=0).tolist()


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (16, 8))
    points = (centres[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int32)
    order, nodes = ct.build(points)
    _, whole = ct.assign(points[order], nodes, centres)
    assert whole > 1900

"""Alignment of tokens against whole texts encoded in one go, with all links written out."""

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coinbrook.llm import token_alignment as ta
from coinbrook.llm.token_bytes import tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(ta.FIRST), reason="no vocabulary files")

ODD = [
    None,
    "",
    " ",
    "   ",
    "a",
    " a",
    "a ",
    "two  spaces   and\tone tab\n\nlines \n end",
    "<|endoftext|> and <s> are text </s>",
    "an underline ▁ of the second tokenizer",
    "naïve café, 日本語のテキスト — and 😀 emoji",
    "x" * 300,
    "nul \x00 and bell \x07 and   no break 　 wide \x85 next \x1c sep",
    "'s 'll 've 1234 5678,90",
    "same text", "same text", "same text",
]


def whole(text):
    """Ids and groups of a text encoded in one go; None if it is not given back."""
    if not text:
        return None
    first, second = tokenizer(ta.FIRST), tokenizer(ta.SECOND)
    [a], [b] = first.encode([" " + text]), second.encode([" " + text])
    bytes_a, bytes_b = [first.bytes[k] for k in a], [second.bytes[k] for k in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None

    def ends(parts):
        at, found = 0, []
        for part in parts:
            at += len(part)
            found.append(at)
        return found

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, before = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        groups.append(
            (
                [k for k, e in zip(a, ends_a) if before < e <= cut],
                [k for k, e in zip(b, ends_b) if before < e <= cut],
            )
        )
        before = cut
    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(texts):
    groups = [whole(t) for t in texts]
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for g in groups]
    counts = Counter(pair for own in links for pair in set(own))
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return [
        (
            sum(len(a) for a, _ in g or []),
            sum(len(b) for _, b in g or []),
            len(g or []),
            len(own),
            sum(counts[p] == highest[p[0]] for p in own),
            sum(counts[p] for p in own),
            written(g or []),
        )
        for g, own in zip(groups, links)
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def result(frame):
    return {r["place"]: tuple(r[c] for c in COLUMNS) for r in frame.select("row.place", *COLUMNS).collect()}


@pytest.fixture(scope="module")
def placed(spark):
    def build(texts):
        return spark.createDataFrame(list(enumerate(texts)), "place int, text string").repartition(3)

    return build


@pytest.mark.parametrize(
    "settings",
    [{}, {"chunk": 7, "fan": 2}, {"chunk": 40, "fan": 3, "head_pairs": 5}, {"head_pairs": 0}],
    ids=["whole", "small chunks", "chunks and tail", "all tail"],
)
def test_equals_brute_force(placed, texts, settings):
    own = ODD + [t for _, t, _ in texts[:12]]
    if "chunk" in settings:
        own = ODD + [t[:600] for _, t, _ in texts[:8] if t]
    got = result(ta.align(placed(own), **settings))
    assert [got[k] for k in range(len(own))] == brute(own)


def test_digest_and_clashing_names(spark):
    rows = [(1, "a b", 5, 6, "x", 0, 1), (1, "a b", 5, 6, "x", 0, 1), (None, None, None, None, None, None, None)]
    names = "doc_id int, text string, key int, pair int, groups string, row int, no int"
    frame = spark.createDataFrame(rows, names)
    digest = hashlib.sha256(written(whole("a b")).encode()).hexdigest()
    for more in ({}, {"chunk": 1, "head_pairs": 0}):
        got = ta.align(frame, digest=True, **more).collect()
        assert sorted((r["row"]["doc_id"] or 0, r["count_sum"], r["groups"]) for r in got) == [
            (0, 0, ""),
            (1, 4, digest),
            (1, 4, digest),
        ]
        assert sorted((tuple(r["row"]) for r in got), key=repr) == sorted(rows, key=repr)


def test_empty_table(placed):
    assert ta.align(placed(["x"]).filter("place < 0")).count() == 0


TEXT = st.text(alphabet=" ab▁\n\t é1.'", max_size=40)


@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_fragments_are_a_monoid(parts, at):
    store = ta._units(ta.FIRST, ta.SECOND)
    fragments = [ta.Fragment.of(p, store) for p in parts]

    def fold(some):
        whole_of = ta.Fragment()
        for one in some:
            whole_of = whole_of.join(one, store)
        return whole_of

    at = min(at, len(parts))
    left_first = fold(fragments)
    halves = fold(fragments[:at]).join(fold(fragments[at:]), store)
    right_first = ta.Fragment()
    for one in reversed(fragments):
        right_first = one.join(right_first, store)
    assert left_first.whole(store) == halves.whole(store) == right_first.whole(store)
    text = "".join(parts)
    groups, found = whole(text), left_first.whole(store)
    assert (found is None) == (groups is None and text != "")
    if groups is not None:
        ids = [np.frombuffer(x, kind).tolist() for x, kind in zip(found, store.codes)]
        assert ids == [[k for own in groups for k in own[side]] for side in (0, 1)]


def test_wide_groups(placed, monkeypatch):
    monkeypatch.setattr(ta, "WIDE_GROUP", 1)
    texts = ["日本語のテキスト 日本語", "x" * 50, "a b c", "日本語のテキスト"]
    part = ta._units(ta.FIRST, ta.SECOND)
    part.learn({u for t in texts for u in ta.CUT.split(t)})
    ids = [part.ids(ta.CUT.split(t)) for t in texts]
    own = ta._Aligned(pa.RecordBatch.from_arrays([pa.array([i[k] for i in ids]) for k in (0, 1)], names=["a", "b"]), part)
    narrow = own.pairs()
    monkeypatch.setattr(ta, "WIDE_GROUP", 1 << 12)
    assert [x.tolist() for x in narrow] == [x.tolist() for x in own.pairs()]
    assert (own.links_of_group > 1).any()


def test_odd_units_leave_the_others_alone():
    store = ta.Units(ta.FIRST, ta.SECOND)
    store.learn({"fine", "od▁d", "größe", "日本"})
    assert store.ids(["fine", "größe", "日本"]) is not None and store.ids(["fine", "od▁d"]) is None
    assert store._odd == {"od▁d"}


def test_long_text_is_spread_over_tasks(spark, placed):
    text = " ".join(f"word{k} of" for k in range(400))
    frame = placed([text])
    chunks = ta._chunks(frame.selectExpr("struct(place) as row", "text"), 100)
    fragments = ta._fragments(chunks, ta.FIRST, ta.SECOND)
    assert chunks.count() == -(-len(text) // 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = fragments.groupBy(F.spark_partition_id()).count().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1
    assert result(ta.align(frame, chunk=100, fan=2))[0] == brute([text])[0]

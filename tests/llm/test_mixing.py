import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import mixing


def raked(tokens, targets, rounds=200):
    """Iterative proportional fitting in numpy."""
    w = tokens.astype(float)
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            others = tuple(a for a in range(w.ndim) if a != axis)
            shape = [-1 if a == axis else 1 for a in range(w.ndim)]
            w = w * (np.array(target) * tokens.sum() / w.sum(others)).reshape(shape)
    return w


def test_weights_against_numpy(spark):
    draw = np.random.default_rng(3)
    tokens = draw.integers(1, 500, (4, 3, 2))
    names = [[f"s{i}" for i in range(4)], ["en", "de", None], ["prose", "list"]]
    cells = [(names[0][i], names[1][j], names[2][k], int(tokens[i, j, k])) for i, j, k in np.ndindex(4, 3, 2)]
    shares = [[0.4, 0.3, 0.2, 0.1], [0.2, 0.5, 0.3], [0.6, 0.4]]
    targets = {
        d: spark.createDataFrame(list(zip(n, s, strict=True)), "value string, share double")
        for d, n, s in zip(mixing.DIMENSIONS, names, shares, strict=True)
    }
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(frame, targets).collect()}
    want = raked(tokens, shares)
    for i, j, k in np.ndindex(4, 3, 2):
        assert got[names[0][i], names[1][j], names[2][k]] == pytest.approx(want[i, j, k], rel=1e-6)


def test_targets_of_absent_values_are_left_out(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "x", "t", 30), ("c", "x", "t", 0)], "source string, lang string, topic string, tokens long")
    source = spark.createDataFrame([("a", 0.25), ("b", 0.25), ("z", 0.5)], "value string, share double")
    one = spark.createDataFrame([("x", 1.0)], "value string, share double")
    topic = spark.createDataFrame([("t", 1.0)], "value string, share double")
    got = {r.source: r.weight for r in mixing.rake(cells, {"source": source, "lang": one, "topic": topic}).collect()}
    assert got["a"] == pytest.approx(20) and got["b"] == pytest.approx(20) and got["c"] == 0


def test_sample_meets_its_share_of_tokens(docs, texts):
    rows = docs([(d, t, lang) for d, t, lang in texts])
    found = mixing.mix(rows).collect()
    assert len(found) == len(texts)
    total = sum(r.n_tokens for r in found)
    assert sum(r.n_tokens * r.probability for r in found) == pytest.approx(mixing.TOKEN_SHARE * total, rel=1e-3)
    assert all(0 <= r.probability <= 1 for r in found)
    assert all(r.n_tokens == len((r.row.text or "").split()) for r in found)
    again = {r.row.doc_id for r in mixing.mix(rows.repartition(3)).collect() if r.sampled}
    assert again == {r.row.doc_id for r in found if r.sampled}
    sums = collections.Counter()
    for r in found:
        sums[r.source] += r.n_tokens * r.weight
    natural = collections.Counter()
    for r in found:
        natural[r.source] += r.n_tokens
    raised = {s: n**0.5 for s, n in natural.items()}
    for s in sums:
        assert sums[s] / total == pytest.approx(raised[s] / sum(raised.values()), rel=1e-4)


def test_nulls_empty_texts_and_clashing_columns(spark):
    rows = [(1, None, None, None, 1), (2, "", "en", "a", 1), (3, "w x y", "en", "a", 1), (None, "w", None, "a", 1), (3, "w x y", "en", "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    found = mixing.mix(frame.withColumn("weight", F.lit("z"))).collect()
    assert len(found) == 5
    assert {r.row.doc_id: r.n_tokens for r in found} == {1: 0, 2: 0, 3: 3, None: 1}
    assert all(r.probability == 0 for r in found if r.row.doc_id == 1)
    assert len({r.sampled for r in found if r.row.doc_id == 3}) == 1
    assert mixing.mix(frame.filter("doc_id = 9")).count() == 0


def test_topic_by_a_column(docs):
    frame = docs([(1, "a b"), (2, "c d e")])
    found = mixing.mix(frame, topic=F.concat(F.lit("t"), F.col("doc_id"))).collect()
    assert {r.row.doc_id: r.topic for r in found} == {1: "t1", 2: "t2"}


def test_only_sampled_rows_are_returned(docs, texts):
    rows = docs([(d, t, lang) for d, t, lang in texts])
    sampled = mixing.sample_mix(rows, token_share=0.5)
    assert sampled.columns == [*rows.columns, "mix_probability"]
    assert 0 < sampled.count() < len(texts)


def test_no_python_in_the_plan(docs):
    plan = mixing.mix(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from coinbrook.llm import gru, language_id, lm_scoring


def crc(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


# -- language ------------------------------------------------------------------------------


def test_held_out_accuracy(docs, texts):
    rows = [(d, t, lang) for d, t, lang in texts]
    found = language_id.identify(docs(rows)).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in found)
    lang = {d: x for d, _, x in texts}
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_do_not_matter(docs, texts):
    rows = [(d, t, lang) for d, t, lang in texts]
    wrong = [(d, t, "xx" if crc(d, 5) == 0 else lang) for d, t, lang in rows]
    one = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs(rows)).collect()}
    two = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs(wrong)).collect()}
    assert one == two


def test_texts_without_letters_and_nulls(docs):
    rows = [(k, "the cat sat on the mat", "en") for k in range(20)] + [(k, "der hund saß auf", "de") for k in range(20, 40)]
    rows += [(100, None), (101, ""), (102, "123 !?"), (None, "the mat"), (103, "the cat", None), (104, "Der Hund " * 60_000)]
    found = {r.doc_id: (r.lang_pred, r.held_out, r.score) for r in language_id.identify(docs(rows)).collect()}
    assert [found[k][0] for k in (100, 101, 102)] == ["und"] * 3 and found[101][2] == 0
    assert found[None][0] == "en" and found[None][1] is False
    assert found[104][0] == "de"
    kept = {r.doc_id for r in language_id.keep_identified(docs(rows)).collect()}
    assert not kept & {100, 101, 102} and {104, 0, 25} <= kept


def test_without_labels_or_rows(docs):
    none = language_id.identify(docs([(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert language_id.identify(docs([])).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Äpfel und Birnen, 12 Nüsse " * 400
    whole = language_id.counts_of(text)
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert (language_id.counts_of(text) == whole).all()


def test_temperature_lowers_the_loss():
    draw = np.random.default_rng(1)
    labels = draw.integers(0, 3, 400)
    logits = np.eye(3)[np.where(draw.random(400) < 0.7, labels, draw.integers(0, 3, 400))] * 9
    t = language_id.fit_temperature(logits, labels)
    assert t > 2
    p = language_id._softmax(logits / t)[np.arange(400), labels]
    assert -np.log(p).mean() < -np.log(language_id._softmax(logits)[np.arange(400), labels]).mean()


# -- scores --------------------------------------------------------------------------------


def base_scores(rows):
    words = [((t or "").encode().lower().split(), d) for d, t in rows]
    counts = Counter()
    for own, d in words:
        if d is None or crc(d, 5) != 1:
            counts.update([*own, b""])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for own, d in words:
        logs = [math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*own, b""]]
        out.append((d, len(logs), sum(counts[w] > 0 for w in [*own, b""]), total, round(sum(logs), 6)))
    return sorted(out, key=repr)


def scored(frame, **options):
    found = lm_scoring.score(frame, **options).collect()
    return found, sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr)


def test_base_scores_and_held_out_likelihood(docs, texts):
    rows = [(d, t) for d, t, _ in texts]
    found, base = scored(docs(rows), head_words=500, neural_words=100)
    assert base == base_scores(rows)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in rows if crc(d, 5) == 1}
    assert sum(r.score for r in held) > sum(r.base_score for r in held), "the model should beat word frequencies"


def test_nulls_repeats_and_long_texts(docs):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a zz"), (4, "a " * 30_000), (5, "w" * 5000 + " a")]
    found, base = scored(docs(rows), head_words=3, neural_words=2)
    assert base == base_scores(rows)
    assert all(r.score < 0 for r in found)


def test_empty_and_untrained(docs):
    assert lm_scoring.score(docs([])).count() == 0
    held = next(d for d in range(100) if crc(d, 5) == 1)
    found, base = scored(docs([(held, "a b")]))
    assert base == base_scores([(held, "a b")])


def test_sizes_of_the_model():
    """They decide every score, so they are not a means against a CPU budget."""
    assert (gru.EMBEDDING, gru.HIDDEN, gru.LANES) == (16, 24, 256)
    assert (lm_scoring.NEURAL_WORDS, lm_scoring.CLASSES) == (1500, 40)


def test_the_start_is_fitted_in_a_task(docs, texts, monkeypatch):
    rows = docs([(d, t) for d, t, _ in texts] + [(10**6 + k, "many copies") for k in range(30)])
    monkeypatch.setattr(lm_scoring, "START_DOCS", 20)
    by_hash = [r.text for r in rows.select("text").orderBy(F.xxhash64("text")).limit(20).collect()]
    assert [r.text for r in lm_scoring._start(rows).collect()] == by_hash

    def in_the_driver(*_, **__):
        raise AssertionError("texts are trained on in the driver")

    monkeypatch.setattr(gru, "train", in_the_driver)
    head = lm_scoring.head_of(lm_scoring.token_counts(rows), 500, 100)
    weights = lm_scoring.train(rows, head)
    assert weights is not None and np.isfinite(weights).all()
    assert not np.array_equal(weights, lm_scoring._new_model(head).vector())


def test_model_gives_a_distribution():
    """The probabilities of all next words sum to one."""
    counts = np.array([50, 30, 20, 10, 5, 4, 3, 2, 1, 1], float)
    model = gru.Model(10, gru.classes_of(counts, 4))
    model.start_from(counts, 7)
    model.load(np.random.default_rng(0).standard_normal(model.vector().size).astype(np.float32) * 0.3)
    docs = [np.array([3, 1, w]) for w in range(11)]  # the last stands for all other words
    prefix = gru.log_likelihoods(model, [np.array([3, 1])], 0)[0]
    assert abs(np.exp(gru.log_likelihoods(model, docs, 0) - prefix).sum() - 1) < 1e-4


def test_state_is_carried_over_windows(monkeypatch):
    draw = random.Random(3)
    docs = [np.array([draw.randrange(8) for _ in range(n)]) for n in (70, 1, 33, 5)]
    model = gru.Model(8, np.array([0, 2, 8]))
    model.load(np.random.default_rng(0).standard_normal(model.vector().size).astype(np.float32) * 0.3)
    one = gru.log_likelihoods(model, docs, 0)
    monkeypatch.setattr(gru, "WINDOW", 1000)
    assert np.allclose(one, gru.log_likelihoods(model, docs, 0), atol=1e-3)


def test_scores_are_those_of_training_with_fewer_outputs(monkeypatch):
    """Outputs are worked out for many windows together; lanes and blocks do not change a score."""
    draw = random.Random(4)
    docs = [np.array([draw.randrange(20) for _ in range(n)]) for n in (1, 90, 200, 3, 41, 41, 7)]
    model = gru.Model(12, np.array([0, 1, 5, 12]))
    model.load(np.random.default_rng(0).standard_normal(model.vector().size).astype(np.float32) * 0.3)
    trained = [gru.train(gru.Trainer(model, 0.0), [d], 0)[0] for d in docs]
    calls = []
    outputs = gru._Reader.logs
    monkeypatch.setattr(gru._Reader, "logs", lambda self, *a: calls.append(len(a[1])) or outputs(self, *a))
    one = gru.log_likelihoods(model, docs, 0)
    assert np.allclose(one, trained, atol=1e-3)
    assert calls == [sum(len(d) for d in docs)], "13 windows, one call"
    monkeypatch.setattr(gru, "SCORED_LANES", 2)
    monkeypatch.setattr(gru, "SCORED_WORDS", 10)
    assert np.allclose(gru.log_likelihoods(model, docs, 0), one, atol=1e-4)
    assert gru.log_likelihoods(model, [], 0).size == 0


def test_gradients_by_finite_differences(monkeypatch):
    docs = [np.array([1, 4, 2, 0]), np.array([3, 0])]
    model = gru.Model(5, np.array([0, 2, 5]))
    model.load(np.random.default_rng(5).standard_normal(model.vector().size).astype(np.float32) * 0.3)
    caught = {}

    def catch(self, grads, n):
        caught.update({k: g.copy() for k, g in grads.items()})

    monkeypatch.setattr(gru.Trainer, "_step", catch)
    gru.train(gru.Trainer(model), docs, 0)
    for name in gru.Model.NAMES:
        weights = getattr(model, name)
        at = np.unravel_index(np.abs(caught[name]).argmax(), weights.shape)
        before, step = weights[at], 1e-2
        weights[at] = before + step
        up = gru.log_likelihoods(model, docs, 0).sum()
        weights[at] = before - step
        down = gru.log_likelihoods(model, docs, 0).sum()
        weights[at] = before
        assert abs(caught[name][at] + (up - down) / (2 * step)) < 0.03 * abs(caught[name][at]) + 2e-3, name

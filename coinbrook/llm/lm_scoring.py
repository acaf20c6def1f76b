"""Scores of documents by a gated recurrent language model and by word frequencies.

1. Words of all training documents are counted; each document ends with one end.
2. The most frequent words are sent to the tasks with their counts (``HEAD_WORDS``, a fixed number).
   The first of them are the vocabulary of the recurrent model; all others are one class of it,
   within which a word has its relative frequency.
3. The model is trained on all training documents: a start on a bounded sample in one task, then one pass in which
   every task goes on from there over its own documents, and the average of what the tasks got,
   weighted by their words. The average is folded over sorted streams, one model at a time.
4. Every document is scored in one go, its state carried over windows. Words that are not among the
   frequent ones are joined to their counts, and the parts are summed by document.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm import gru
from coinbrook.llm.common import Batches, by_arrow
from coinbrook.llm.language_id import fold
from coinbrook.sinks.scratch import materialize

#: Words sent to every task, and the longest of them in bytes: at most about 10 MB.
HEAD_WORDS, HEAD_BYTES = 1 << 17, 64
#: Vocabulary and classes of the recurrent model.
NEURAL_WORDS, CLASSES = 1500, 40
#: Documents of the sample that training starts on.
START_DOCS = 400
#: Words that a task trains on or scores side by side.
POOL_WORDS = 1_500_000
#: Words counted by a task before it passes the counts on.
COUNTED_WORDS = 200_000
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def token_counts(texts: DataFrame) -> DataFrame:
    """``token``, ``c``: how often each word occurs in ``text``. The end is the empty word."""

    def count(batches: Batches) -> Batches:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"]
            )

        for b in batches:
            for text in b.column("text").to_pylist():
                found.update(tokens_of(text))
                found[END] += 1
            if len(found) > COUNTED_WORDS:
                yield out()
                found.clear()
        yield out()

    return by_arrow(texts.select("text"), count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The frequent words and the totals. Small enough to be sent to every task."""

    words: bytes
    counts: np.ndarray
    neural: int
    total: int
    distinct: int

    def places(self) -> dict[bytes, int]:
        """The place of each word in order of frequency."""
        return {w: k for k, w in enumerate(self.words.split(b" "))} if len(self.counts) else {}

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed frequency of words with these counts."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def others(self) -> tuple[int, int]:
        """Number and distinct number of training words outside the model's vocabulary."""
        return self.total - int(self.counts[: self.neural].sum()), self.distinct - self.neural

    def within_logs(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of such a word within the class of all other words."""
        n, distinct = self.others()
        return np.log10((counts + 0.5) / (n + 0.5 * (distinct + 1)))


def head_of(counts: DataFrame, head_words: int = HEAD_WORDS, neural_words: int = NEURAL_WORDS) -> Head:
    """The most frequent words, as many as fit, and the end.

    Words are taken by level of frequency, sixteen levels for each doubling, so a histogram of a few
    hundred rows tells how many levels fit, and no more than ``head_words`` reach the driver.
    """
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    short = counts.filter(F.length("token") <= HEAD_BYTES).withColumn("level", F.floor(16 * F.log2("c")))
    sizes = sorted(((r["level"], r["count"]) for r in short.groupBy("level").count().collect()), reverse=True)
    least, taken = float("inf"), 0
    for level, n in sizes:
        if taken + n > head_words:
            break
        least, taken = level, taken + n
    is_end = F.length("token") == 0
    wanted = short.filter((F.col("level") >= F.lit(least)) | is_end).select("token", "c")
    # The end comes first, so it always belongs to the vocabulary of the model.
    rows = sorted(wanted.collect(), key=lambda r: (bytes(r.token) != END, -r.c, bytes(r.token)))
    counted = np.array([r.c for r in rows], np.int64)
    return Head(b" ".join(bytes(r.token) for r in rows), counted, min(neural_words, len(rows)), total or 0, distinct)


class _Places(dict):
    """The place of each frequent word; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Places of the words and of the end after them."""
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return np.append(out, self[END])


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % gru.BUCKETS


class _Ids:
    """Turns words into the model's ids: places in its vocabulary, then hash buckets."""

    def __init__(self, head: Head) -> None:
        self.places, self.neural = _Places(head.places()), head.neural
        self.end = self.places[END]
        buckets = [head.neural + _bucket(w) for w in itertools.islice(self.places, head.neural, None)]
        self.of_place = np.concatenate([np.arange(head.neural), np.array(buckets, np.int64)])

    def of(self, tokens: list[bytes], places: np.ndarray) -> np.ndarray:
        ids = self.of_place[places]
        for k in np.flatnonzero(places < 0):
            ids[k] = self.neural + _bucket(tokens[k])
        return ids


def _new_model(head: Head) -> gru.Model:
    counts = head.counts[: head.neural].astype(np.float64)
    model = gru.Model(head.neural, gru.classes_of(counts, CLASSES))
    model.start_from(counts, head.others()[0])
    return model


def _pools(texts: Iterator[str | None], ids: _Ids) -> Iterator[list[np.ndarray]]:
    pool, words = [], 0
    for text in texts:
        tokens = tokens_of(text)
        pool.append(ids.of(tokens, ids.places.of(tokens)))
        words += len(pool[-1])
        if words > POOL_WORDS:
            yield pool
            pool, words = [], 0
    if pool:
        yield pool


def _average(models: DataFrame, *keys: str) -> DataFrame:
    """Weighted mean of the models of each key; one model is held at a time."""

    def average(batches: Batches) -> Batches:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            total, words, share = 0.0, 0, 0
            for r in group:
                total = total + np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["words"]
                words, share = words + r["words"], r["share"]
            mean = (total / words).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([share], pa.int32()), pa.array([words], pa.int64()), pa.array([mean.tobytes()], pa.binary())],
                names=["all", "share", "words", "weights"],
            )

    ordered = models.repartition(*keys).sortWithinPartitions(*keys)
    return by_arrow(ordered, average, "all int, share int, words long, weights binary")


def _start(texts: DataFrame) -> DataFrame:
    """The ``START_DOCS`` texts with the smallest hashes, in one partition, so it depends on the texts alone.

    Hashes are counted by level first, sixteen for each doubling, so that hardly more texts than are
    wanted go to the task that orders them.
    """
    hashed = texts.select("text", F.xxhash64("text").alias("h"))
    level = F.floor(16 * F.log2(F.col("h") + F.lit(2.0**63 + 1)))
    sizes = hashed.groupBy(level.alias("level")).count().collect()  # at most sixteen rows for each bit
    last, taken = -1, 0
    for r in sorted(sizes, key=lambda r: r["level"]):
        last, taken = r["level"], taken + r["count"]
        if taken >= START_DOCS:
            break
    return hashed.filter(level <= last).orderBy("h").limit(START_DOCS).select("text")


def _fit_start(texts: DataFrame, sent: Broadcast[Head]) -> np.ndarray:
    """Weights after the start. One task fits them, a pool of texts at a time; the weights alone return."""

    def fit(batches: Batches) -> Batches:
        ids, model = _Ids(sent.value), _new_model(sent.value)
        trainer, learned = gru.Trainer(model), False
        for pool in _pools((t for b in batches for t in b.column("text").to_pylist()), ids):
            gru.train(trainer, pool, ids.end, lanes=32)
            learned = True
        if learned:
            yield pa.RecordBatch.from_arrays([pa.array([model.vector().tobytes()], pa.binary())], names=["weights"])

    rows = by_arrow(_start(texts), fit, "weights binary").collect()  # one row
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else _new_model(sent.value).vector()


def train(texts: DataFrame, head: Head, shares: int = 64) -> np.ndarray | None:
    """Weights after the start and one pass over all ``texts``; null if there are no words to learn."""
    if not head.neural:
        return None
    context = texts.sparkSession.sparkContext
    sent_head = context.broadcast(head)
    started = _fit_start(texts, sent_head)
    sent_weights = context.broadcast(started)

    def learn(batches: Batches) -> Batches:
        known = sent_head.value
        own = _new_model(known).load(sent_weights.value)
        trainer = gru.Trainer(own, gru.RATE / 4)
        ids, words = _Ids(known), 0
        found = (t for b in batches for t in b.column("text").to_pylist())
        for pool in _pools(found, ids):
            words += gru.train(trainer, pool, ids.end)[1]
        if words:
            share = TaskContext.get().partitionId() % shares
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([share], pa.int32()), pa.array([words], pa.int64()), pa.array([own.vector().tobytes()], pa.binary())],
                names=["all", "share", "words", "weights"],
            )

    learned = by_arrow(texts.select("text"), learn, "all int, share int, words long, weights binary")
    rows = _average(_average(learned, "share"), "all").collect()  # one row
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else started


_SCORED = (
    "row_key long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, "
    "token binary, times long"
)


def _score(docs: DataFrame, head: Head, weights: np.ndarray | None) -> DataFrame:
    """For each document a row with what the frequent words give, and a row for each other word."""
    sent = docs.sparkSession.sparkContext.broadcast((head, weights))

    def score(batches: Batches) -> Batches:
        head, weights = sent.value
        ids = _Ids(head)
        base = head.base_logs(head.counts)
        within = np.where(np.arange(len(head.counts)) < head.neural, 0.0, head.within_logs(head.counts))
        model = _new_model(head).load(weights) if weights is not None else None
        key = TaskContext.get().partitionId() << 33
        for rows in _row_pools(batches):
            places = [ids.places.of(tokens) for _, _, tokens in rows]
            logs = np.zeros(len(rows))
            if model:
                own = [ids.of(tokens, at) for (_, _, tokens), at in zip(rows, places, strict=True)]
                logs = gru.log_likelihoods(model, own, ids.end) / np.log(10)
            out = _Out()
            for (doc_id, held_out, tokens), at, log in zip(rows, places, logs, strict=True):
                key += 1
                frequent = at[at >= 0]
                # A word cannot begin with a space, so this one has no count, and rows spread evenly.
                out.add(
                    key, doc_id, held_out, len(at), len(frequent), base[frequent].sum(),
                    log + within[frequent].sum(), b" %d" % key, 0,
                )
                # The end is frequent wherever there is anything to learn from.
                others = Counter(tokens[k] if k < len(tokens) else END for k in np.flatnonzero(at < 0))
                out.add_words(key, others)
                if len(out) > 20_000:
                    yield out.batch()
                    out = _Out()
            yield out.batch()

    return by_arrow(docs.select("doc_id", "held_out", "text"), score, _SCORED)


class _Out:
    """Rows for the join: one for a document, and one for each of its words that is not frequent."""

    NAMES = ("row_key", "doc_id", "held_out", "n_tokens", "known", "base", "model", "token", "times")
    KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())

    def __init__(self) -> None:
        self.documents: list[tuple] = []
        self.keys: list[int] = []
        self.words: list[bytes] = []
        self.times: list[int] = []

    def __len__(self) -> int:
        return len(self.documents) + len(self.words)

    def add(self, *row: object) -> None:
        self.documents.append(row)

    def add_words(self, key: int, counted: Counter[bytes]) -> None:
        self.keys += [key] * len(counted)
        self.words += counted.keys()
        self.times += counted.values()

    def batch(self) -> pa.RecordBatch:
        n = len(self.words)
        columns = [list(c) for c in zip(*self.documents, strict=True)] or [[] for _ in self.NAMES]
        more = (self.keys, [None] * n, [None] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n, self.words, self.times)
        arrays = [pa.array(c + m, k) for c, m, k in zip(columns, more, self.KINDS, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=list(self.NAMES))


def _row_pools(batches: Batches) -> Iterator[list[tuple]]:
    pool, words = [], 0
    for b in batches:
        for doc_id, held_out, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
            pool.append((doc_id, held_out, tokens_of(text)))
            words += len(pool[-1][2]) + 1
            if words > POOL_WORDS:
                yield pool
                pool, words = [], 0
    if pool:
        yield pool


def score(docs: DataFrame, head_words: int = HEAD_WORDS, neural_words: int = NEURAL_WORDS) -> DataFrame:
    """Scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents whose fold of five is 1 are held out; the others, with those that have no doc_id, are
    learned from. A null text is empty, so its only token is the end. ``base_score`` sums log10 of the
    smoothed frequencies, ``score`` is the log10 probability of the whole text under the recurrent
    model. Rows that repeat are scored one by one. Without training documents every word is unknown,
    and both scores use the smoothing alone.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (fold(5) == 1).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    learned = rows.filter("not held_out")
    counts = materialize(token_counts(learned), "token-counts")
    head = head_of(counts, head_words, neural_words)
    parts = _score(rows, head, train(learned, head))
    n, distinct = head.others()
    base = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(head.total + 0.5 * (head.distinct + 1)))
    within = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(n + 0.5 * (distinct + 1)))
    joined = parts.join(counts, "token", "left").select(
        "row_key",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("times") * base).alias("base"),
        (F.col("model") + F.col("times") * within).alias("model"),
    )
    summed = joined.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("model").alias("score"),
    )
    return summed.drop("row_key")

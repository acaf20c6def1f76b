"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

* Features: n-grams of one to three characters over the lower-cased letters of a text, every other
  run of characters being one space. They are hashed into ``BUCKETS`` places; a place has the value
  (1 + ln count) * idf, and the vector has length one. Document frequencies are counted over all
  training rows.
* Weights: FTRL-proximal (per-coordinate rates, L1 and L2 penalties) on a sample of the labelled
  training rows, balanced over languages; L1 leaves most weights at exactly zero.
* Temperature: fitted on a part of the sample that the weights have not seen.

Training on a sample is bounded by ``SAMPLE_ROWS``; counting and prediction cover every row and the
whole of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import Batches, by_arrow

BUCKETS = 1 << 15
MAX_N = 3
#: Bound of the labelled sample, over all languages.
SAMPLE_ROWS = 4000
#: At most so many languages are learned, the most frequent ones.
MAX_LANGUAGES = 500
EPOCHS = 3
RATE, RATE_BASE, L1, L2 = 2.0, 1.0, 0.02, 0.02
UNKNOWN = "und"
#: Characters that are turned into features at a time.
PIECE = 1 << 18

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str) -> np.ndarray:
    """Code points of the letters in lower case, each other run of characters as one zero."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[points], points, 0)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes = codes[keep]
    if not codes.any():
        return codes[:0]
    return np.pad(codes, (int(codes[0] != 0), int(codes[-1] != 0)))


def counts_of(text: str | None) -> np.ndarray:
    """How often each place occurs. All zero for a text without letters."""
    counts = np.zeros(BUCKETS, np.int64)
    if not text:
        return counts
    codes = _codes(text).astype(np.uint32)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + MAX_N - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, MAX_N + 1):
            # From the last n-gram's hash to the one with a further character.
            h = (h[: len(part) - n + 1] ^ (part[n - 1 :] * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            own = min(PIECE, len(codes) - at - n + 1)
            if own > 0:
                counts += np.bincount(h[:own] & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place occurs, and the number of texts with letters.

    Tasks send one total for each place, whatever their number of rows.
    """

    def count(batches: Batches) -> Batches:
        totals, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                found = counts_of(text) > 0
                totals += found
                n += bool(found.any())
        places = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(places, -1), pa.int32()),
                pa.array(np.append(totals[places], n), pa.int64()),
            ],
            names=["place", "n"],
        )

    totals = by_arrow(rows.select("text"), count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    frequency, n = np.zeros(BUCKETS, np.int64), 0
    for r in totals.collect():  # at most one row for each place
        if r.place < 0:
            n = r.n
        else:
            frequency[r.place] = r.n
    return frequency, n


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the TF-IDF vector of a text."""
    places = np.flatnonzero(counts)
    values = (1 + np.log(counts[places])) * idf[places]
    length = np.sqrt(np.sum(values * values))
    return places.astype(np.int32), (values / length if length else values).astype(np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(
    vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, seed: int = 0
) -> np.ndarray:
    """Weights by the follow-the-regularised-leader recipe, one text at a time."""
    z, squares = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))

    def weights(zs: np.ndarray, ss: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((RATE_BASE + np.sqrt(ss)) / RATE + L2)

    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in random.permutation(len(vectors)):
            places, values = vectors[k]
            if len(places) == 0:
                continue
            zs, ss = z[:, places], squares[:, places]
            w = weights(zs, ss)
            error = _softmax(w @ values)
            error[labels[k]] -= 1
            g = error[:, None] * values
            step = (np.sqrt(ss + g * g) - np.sqrt(ss)) / RATE
            z[:, places] = zs + g - step * w
            squares[:, places] = ss + g * g
    return weights(z, squares).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if len(labels) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counts_of(text)
        if not self.languages or not counts.any():
            return UNKNOWN, 0.0
        places, values = vector(counts, self.idf)
        p = _softmax((self.weights[:, places] @ values).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _share(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages in ``rows`` (``doc_id``, ``text``, ``lang``); null labels are left out."""
    labelled = rows.filter("lang is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS), np.float32), 1.0)
    frequency, n = document_frequency(labelled)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    # As many rows of each language; the limit only holds where one doc_id stands for many rows.
    wanted = max(1, sample_rows // len(languages))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], wanted / r["count"])])
    sample = labelled.filter(_share(F.col("doc_id"), 1) <= shares[F.col("lang")]).limit(2 * sample_rows)

    def features(batches: Batches) -> Batches:
        for b in batches:
            found = [vector(counts_of(t), idf) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("lang"),
                    pa.array([p.tobytes() for p, _ in found], pa.binary()),
                    pa.array([v.tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "lang", "places", "values"],
            )

    schema = "lang string, places binary, `values` binary"
    found = by_arrow(sample, features, schema, doc_id=labelled.schema["doc_id"].dataType)
    # The sample is bounded, so one task can hold it. A fixed order, so that the same rows always give
    # the same model.
    found = found.withColumns({"all": F.lit(0), "place": F.xxhash64("doc_id", "places")})
    ordered = found.repartition("all").sortWithinPartitions("place", "lang").select("lang", "places", "values")

    def fit(batches: Batches) -> Batches:
        vectors, names = [], []
        for b in batches:
            names += b.column("lang").to_pylist()
            for p, v in zip(b.column("places").to_pylist(), b.column("values").to_pylist(), strict=True):
                vectors.append((np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)))
        if not vectors:
            return
        labels = np.array([languages.index(n) for n in names], np.int64)
        held_back = np.arange(len(vectors)) % 5 == 4
        weights = train_ftrl([v for v, h in zip(vectors, held_back, strict=True) if not h], labels[~held_back], len(languages))
        logits = [(weights[:, p] @ v) for (p, v), h in zip(vectors, held_back, strict=True) if h]
        logits = np.array(logits, np.float64).reshape(-1, len(languages))
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([fit_temperature(logits, labels[held_back])])],
            names=["weights", "temperature"],
        )

    fitted = by_arrow(ordered, fit, "weights binary, temperature double").collect()
    if not fitted:
        return Model([], idf, np.zeros((0, BUCKETS), np.float32), 1.0)
    weights = np.frombuffer(fitted[0]["weights"], np.float32).reshape(len(languages), BUCKETS)
    return Model(languages, idf, weights, fitted[0]["temperature"])


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``row`` (its columns in ``carry``, by default all), ``lang_pred``, ``score``.

    ``row`` is a struct of all columns. A text that is null or has no letter is ``und`` with score 0,
    and so is every text if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Batches) -> Batches:
        known = shared.value
        for b in batches:
            found = [known.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["row", "lang_pred", "score"],
            )

    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return by_arrow(rows, label, "lang_pred string, score double", row=rows.schema["row"].dataType)


def fold(of: int, column: str = "doc_id") -> Column:
    """crc32 of the decimal text of the id, modulo ``of``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of)), F.lit(-1))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with ``doc_id``, ``held_out``, ``lang_pred`` and ``score``.

    The model learns from the labelled rows of ``docs`` whose fold of five is not 0; a row without a
    doc_id belongs to no fold, so it is learned from and not held out. The label, the source and the
    doc_id are no inputs of a prediction.
    """
    model = train(docs.filter(fold(5) != 0), sample_rows)
    rows = docs.select("doc_id", "text", (fold(5) == 0).alias("held_out"))
    found = predict(rows, model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns.

    Rows without letters go, and those whose best language has a calibrated probability below
    ``least_score``.
    """
    model = train(docs.filter(fold(5) != 0), sample_rows)
    found = predict(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.select("row.*")

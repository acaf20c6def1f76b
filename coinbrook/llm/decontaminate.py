"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is cut into windows of ten consecutive words; an item of fewer words is one window.
A document contains a window when the words of the window follow one another in it.

* The words of a window are ordered by rarity, that is by the number of documents that hold them.
  Full containment needs every word, so a prefix of one word, the rarest, is necessary: only where a
  document holds that word can the window begin.
* The length filter drops documents with fewer words than the window, the positional filter places
  where the window would begin before the document or end after it.
* What is left is verified word by word.

The windows are
sent to the tasks in blocks of a bounded size. A benchmark larger than one block takes a pass over
the documents for each block, and the passes are put together by row.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import Batches, batch, by_arrow
from coinbrook.sinks.scratch import materialize

WINDOW_WORDS = 10
#: Windows that are sent to the tasks at a time; about 200 bytes each.
BLOCK_WINDOWS = 200_000

#: Lower-cases A-Z and makes every other ASCII character that is no letter or digit a space. Bytes
#: above 0x7F belong to letters outside ASCII and stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits or any characters outside ASCII, in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    width = min(size, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``item_id`` (as a string) and ``words`` of every distinct window of every item."""

    def cut(batches: Batches) -> Batches:
        for b in batches:
            ids, out = [], []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for window in set(windows_of(words_of(text), size)):
                    ids.append(item)
                    out.append(b" ".join(window))
            types = {"item_id": pa.string(), "window": pa.binary()}
            yield batch({"item_id": ids, "window": out}, types)

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("item_id is not null")
    return by_arrow(items, cut, "item_id string, window binary").distinct()


def document_frequency(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``word`` and the number of documents that hold it, for words of the benchmark.

    Each task counts its documents' words first; words of no window are left out at the end, where
    the counts of both sides meet.
    """

    def count(batches: Batches) -> Batches:
        types = {"word": pa.binary(), "n": pa.int64()}
        counts: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for text in b.column("text").to_pylist():
                for word in set(words_of(text)):
                    counts[word] += 1
            if len(counts) > 300_000:
                yield batch({"word": list(counts), "n": list(counts.values())}, types)
                counts.clear()
        yield batch({"word": list(counts), "n": list(counts.values())}, types)

    def words(batches: Batches) -> Batches:
        for b in batches:
            found = {w for window in b.column("window").to_pylist() for w in window.split(b" ")}
            yield batch({"word": list(found)}, {"word": pa.binary()})

    # Stored, so that its size is known: small enough, it is broadcast and the counts stay in place.
    wanted = materialize(by_arrow(windows.select("window"), words, "word binary").distinct(), "wanted")
    counted = by_arrow(docs.select(F.col("text").cast("string")), count, "word binary, n long")
    return counted.join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))


class _Block:
    """Windows by their rarest word: where it stands, the words, and the items of the window."""

    def __init__(self, items: dict[bytes, list[str]], frequency: dict[bytes, int]) -> None:
        self.starts: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = defaultdict(list)
        for window, ids in items.items():
            words = window.split(b" ")
            at = min(range(len(words)), key=lambda k: (frequency.get(words[k], 0), words[k], k))
            self.starts[words[at]].append((at, words, ids))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words of a document are hit, and the items that hit them."""
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        known = self.starts.keys()
        for at, word in enumerate(words):
            if word in known:
                for offset, window, ids in self.starts[word]:
                    start = at - offset
                    if start >= 0 and words[start : start + len(window)] == window:
                        hit[start : start + len(window)] = True
                        items.update(ids)
        return hit, sorted(items)


def _runs(hit: np.ndarray) -> list[int]:
    """Begin and end of every run of hit words, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def _search(docs: DataFrame, block: _Block) -> DataFrame:
    """Every row with its number of words, the runs of hit words and the items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches: Batches) -> Batches:
        held = shared.value
        for b in batches:
            n_words, runs, items = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                hit, found = held.find(words)
                n_words.append(len(words))
                runs.append(_runs(hit) if found else [])
                items.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    pa.array(n_words, pa.int64()),
                    pa.array(runs, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["row", "n_words", "runs", "items"],
            )

    rows = docs.select("row", F.col("text").cast("string"))
    schema = "n_words long, runs array<int>, items array<string>"
    return by_arrow(rows, find, schema, row=docs.schema["row"].dataType)


def _blocks(windows: DataFrame, frequency: DataFrame, block_windows: int):
    """The windows in blocks of bounded size, each with the frequencies of its words."""
    by_window = windows.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    count = windows.select("window").distinct().count()
    blocks = max(1, -(-count // block_windows))
    numbered = by_window.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    for k in range(blocks):
        own = numbered.filter(F.col("block") == k).select("window", "items")
        items = {bytes(r.window): list(r.items) for r in own.collect()}
        if blocks == 1:
            words = frequency
        else:
            used = own.select(F.explode(F.split(F.col("window").cast("string"), " ")).alias("word"))
            used = used.select(F.col("word").cast("binary").alias("word")).distinct()
            words = frequency.join(used, "word", "left_semi")
        yield _Block(items, {bytes(r.word): r.n for r in words.collect()})


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW_WORDS,
    block_windows: int = BLOCK_WINDOWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with what the benchmark items found in it.

    Returns ``row`` (a struct of the columns of ``docs`` in ``carry``, by default all), ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``n_items`` and ``items`` (the item_ids as strings, sorted). A null text
    has no words; an item without words or without item_id has no windows; windows that several items
    share count for each. An empty benchmark finds nothing.
    """
    windows = materialize(benchmark_windows(benchmark, size), "windows")
    frequency = materialize(document_frequency(docs, windows), "frequency")
    own = F.struct(*(carry or docs.columns))
    blocks = list(_blocks(windows, frequency, block_windows))
    if len(blocks) == 1:
        found = _search(docs.select(own.alias("row"), "text"), blocks[0])
    else:
        # Rows are told apart by their place in the stored table, not by an id they may lack.
        row = F.struct(F.monotonically_increasing_id().alias("place"), own.alias("own"))
        placed = docs.select(row.alias("row"), "text")
        placed = materialize(placed, "placed")
        passes = None
        for block in blocks:
            one = _search(placed, block)
            passes = one if passes is None else passes.unionByName(one)
        hits = passes.groupBy(F.col("row.place").alias("place")).agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("runs")).alias("runs"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = placed.select("row").join(hits, F.col("row.place") == F.col("place"))
        found = found.select(F.col("row.own").alias("row"), "n_words", "runs", "items")
    return found.select(
        "row", "n_words", _covered("runs").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items"
    )


def _covered(runs: str):
    """Number of words in the union of runs given as begin, end, begin, end, ..."""
    return F.expr(
        f"""aggregate(
            array_sort(transform(sequence(0, greatest(size({runs}) div 2 - 1, 0)),
                k -> named_struct('s', coalesce(get({runs}, 2 * k), 0), 'e', coalesce(get({runs}, 2 * k + 1), 0)))),
            named_struct('end', 0, 'sum', 0L),
            (a, r) -> named_struct('end', greatest(a.end, r.e), 'sum', a.sum + greatest(0, r.e - greatest(a.end, r.s))),
            a -> a.sum)"""
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    return contamination(docs, benchmark, size).filter("n_hit = 0").select("row.*")

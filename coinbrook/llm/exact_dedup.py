"""Exact deduplication of whole texts by Grace hashing.

Rows are first collapsed where they are read, so that a text with very many copies travels only once
per read task. Spark's shuffle then partitions them by a hash of the text. Each task fills an
open-addressing table that compares complete contents. When the table has its share of memory, texts
that are not in it go to spill files by further bits of the hash, and each file is handled in the
same way, until it fits.

Spill files lie where Spark keeps its own spill files, belong to one task, and are removed by it. A
task that is lost is run again from its input.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import Batches, text_of

#: Characters of distinct texts that a table holds before rows are spilled (or, where rows are only
#: collapsed before the shuffle, passed on).
TABLE_CHARS = 24_000_000
FAN_OUT_BITS = 4
_FREE = -1

Row = list  # hash, text, doc_id, group size, payload
HASH, TEXT, ID, SIZE, PAYLOAD = range(5)


class ContentTable:
    """Rows by complete text, with linear probing from a place given by the hash."""

    def __init__(self, places: int = 1 << 10) -> None:
        self.places = np.full(places, _FREE, np.int64)
        self.rows: list[Row] = []
        self.chars = 0

    def _place(self, row: Row) -> int:
        """Where the text is, or the free place where it belongs."""
        places, rows, last = self.places, self.rows, len(self.places) - 1
        # The upper half: rows of one task agree in what the shuffle and spilling went by.
        at = (row[HASH] >> 32) & last
        while (held := places[at]) != _FREE:
            other = rows[held]
            if other[HASH] == row[HASH] and other[TEXT] == row[TEXT]:
                break
            at = (at + 1) & last
        return at

    def merge(self, row: Row) -> bool:
        """Add a row to the group of its text, if the text is known."""
        held = self.places[self._place(row)]
        if held == _FREE:
            return False
        group = self.rows[held]
        group[SIZE] += row[SIZE]
        if row[ID] is not None and (group[ID] is None or row[ID] > group[ID]):
            group[ID], group[PAYLOAD] = row[ID], row[PAYLOAD]
        return True

    def add(self, row: Row) -> None:
        """Take in a row whose text is not known."""
        if 2 * (len(self.rows) + 1) > len(self.places):
            self.places = np.full(2 * len(self.places), _FREE, np.int64)
            for k, known in enumerate(self.rows):
                self.places[self._place(known)] = k
        self.places[self._place(row)] = len(self.rows)
        self.rows.append(row)
        self.chars += len(row[TEXT])


class SpillFiles:
    """One file for each value of the next bits of the hash."""

    def __init__(self, folder: str, level: int, schema: pa.Schema) -> None:
        self.folder, self.level, self.schema = folder, level, schema
        self.waiting: dict[int, list[Row]] = {}
        self.chars: dict[int, int] = {}
        self.writers: dict[int, pa.ipc.RecordBatchStreamWriter] = {}

    def put(self, row: Row) -> None:
        part = (row[HASH] >> (FAN_OUT_BITS * self.level)) & ((1 << FAN_OUT_BITS) - 1)
        self.waiting.setdefault(part, []).append(row)
        self.chars[part] = self.chars.get(part, 0) + len(row[TEXT])
        if self.chars[part] > TABLE_CHARS >> (FAN_OUT_BITS + 2):
            self._write(part)

    def _path(self, part: int) -> str:
        return os.path.join(self.folder, f"{self.level}-{part}.arrow")

    def _write(self, part: int) -> None:
        if part not in self.writers:
            self.writers[part] = pa.ipc.new_stream(self._path(part), self.schema)
        self.writers[part].write_batch(_to_batch(self.waiting.pop(part), self.schema))
        self.chars[part] = 0

    def read(self) -> Iterator[Iterator[Row]]:
        """The rows of each file; the file is removed once its rows are read."""
        for part in list(self.waiting):
            self._write(part)
        for writer in self.writers.values():
            writer.close()
        for part in self.writers:
            yield self._rows(part)
            os.unlink(self._path(part))

    def _rows(self, part: int) -> Iterator[Row]:
        with pa.OSFile(self._path(part)) as source:
            for data in pa.ipc.open_stream(source):
                yield from _rows_of(data)


def _rows_of(data: pa.RecordBatch) -> Iterator[Row]:
    return map(list, zip(*(c.to_pylist() for c in data.columns), strict=True))


def _to_batch(rows: list[Row], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _in_batches(rows: Iterator[Row], schema: pa.Schema) -> Batches:
    some: list[Row] = []
    chars = 0
    for row in rows:
        some.append(row)
        chars += len(row[TEXT])
        if chars > 1_000_000 or len(some) >= 1000:
            yield _to_batch(some, schema)
            some, chars = [], 0
    if some:
        yield _to_batch(some, schema)


def _collapse(rows: Iterator[Row], limit: int) -> Iterator[Row]:
    """Merge rows of equal text as far as the table holds them; pass on the others."""
    found = ContentTable()
    for row in rows:
        if not found.merge(row):
            if found.chars + len(row[TEXT]) <= limit:
                found.add(row)
            else:
                yield row
    yield from found.rows


def _groups(rows: Iterator[Row], limit: int, folder: str, schema: pa.Schema, level: int = 0) -> Iterator[Row]:
    """One row for each text. The first text always goes into the table, so every level gets on."""
    found = ContentTable()
    spill = None
    for row in rows:
        if found.merge(row):
            continue
        if not found.rows or spill is None and found.chars + len(row[TEXT]) <= limit:
            found.add(row)
        else:
            spill = spill or SpillFiles(tempfile.mkdtemp(dir=folder), level, schema)
            spill.put(row)
    yield from found.rows
    del found
    if spill:
        for part in spill.read():
            yield from _groups(part, limit, folder, schema, level + 1)


def _spill_root() -> str | None:
    """The first of the folders that Spark has its executors spill to."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None


def content_groups(docs: DataFrame, payload: list[str], table_chars: int = TABLE_CHARS) -> DataFrame:
    """One row for each distinct text of ``docs`` (``doc_id``, ``text`` and the payload columns).

    Returns ``keep_id`` (the largest doc_id of the text; null if it has none), ``group_size`` and
    ``payload``, a struct of the payload columns of one row with that doc_id. Null counts as the
    empty text. Rows that repeat another row are copies like any other.
    """
    keyed = docs.select(
        F.xxhash64(text_of()).alias("_hash"),
        text_of().alias("_text"),
        F.col("doc_id").alias("_id"),
        F.lit(1).cast("long").alias("_size"),
        F.struct(*[F.col(c) for c in payload]).alias("_payload"),
    )

    def collapse(batches: Batches) -> Batches:
        first = next(batches, None)
        if first is not None:
            rows = (r for b in _chain(first, batches) for r in _rows_of(b))
            yield from _in_batches(_collapse(rows, table_chars), first.schema)

    def group(batches: Batches) -> Batches:
        first = next(batches, None)
        if first is None:
            return
        root = _spill_root()
        if root:
            os.makedirs(root, exist_ok=True)
        folder = tempfile.mkdtemp(prefix="grace-", dir=root)
        try:
            rows = (r for b in _chain(first, batches) for r in _rows_of(b))
            yield from _in_batches(_groups(rows, table_chars, folder, first.schema), first.schema)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    collapsed = keyed.mapInArrow(collapse, keyed.schema).repartition("_hash")
    found = collapsed.mapInArrow(group, keyed.schema)
    return found.select(
        F.col("_id").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_payload").alias("payload")
    )


def _chain(first: pa.RecordBatch, rest: Batches) -> Batches:
    yield first
    yield from rest


def mark_copies(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest doc_id stays; null counts as the empty text, and a null
    doc_id comes before all others. Rows that share the largest doc_id as well as the text are all
    marked as kept; ``drop_copies`` leaves one of them. An empty table gives no rows.

    The table compares contents; rows are told the outcome by SHA-256. Only texts with copies take
    part in that join, whose hot keys adaptive execution splits.
    """
    keyed = docs.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("text_sha256"), "text")
    groups = content_groups(keyed, ["text_sha256"]).filter("group_size > 1")
    groups = groups.select("payload.text_sha256", "keep_id", "group_size")
    marked = keyed.drop("text").join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return marked.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    The rows come straight from the tables that compared them, so the texts are shuffled once.
    """
    found = content_groups(docs, docs.columns)
    return found.select("payload.*")

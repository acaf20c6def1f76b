"""Short codes for vectors: a codebook for each part of them, found by Lloyd's rounds on cover trees.

Vectors become whole numbers, so every result is exact and does not depend on how they are dealt to
tasks. Each task puts its vectors into blocks of bounded size and builds a cover tree over each part
of a block; the blocks are stored once. In each round a task assigns whole subtrees to entries by the
triangle inequality, only the points of undecided leaves being compared one by one, and adds up the
counts and sums of its blocks. What reaches the driver is one sum for each component of each entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from coinbrook.llm import cover_tree
from coinbrook.llm.common import Batches, batch, by_arrow, sent_if_small
from coinbrook.sinks.scratch import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block.
BLOCK = 2048
#: Components are kept within this, so that no squared distance overflows a long.
LARGEST = 1 << 27

#: Codebooks: the entries of each part, as lists of whole numbers.
Codebooks = list[list[list[int]]]


def _bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part of a vector."""
    return [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there, with finite components only."""
    x = F.col(vector).cast("array<double>")
    return vectors.filter(
        x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )


def _block(dim: int, rows: pa.Array, ids: pa.Array, points: np.ndarray, parts: int, entries: int):
    ranks = pc.rank(ids, tiebreaker="dense", null_placement="at_end").to_numpy()
    few = np.flatnonzero(ranks <= np.partition(ranks, min(entries, len(ranks)) - 1)[min(entries, len(ranks)) - 1])
    few = few[np.lexsort([*points[few].T[::-1], ranks[few]])][:entries]
    first = pa.StructArray.from_arrays(
        [ids.take(pa.array(few)), pa.array(points[few].tolist(), pa.list_(pa.int32()))], names=["id", "vector"]
    )
    trees = [cover_tree.build(points[:, b:e]) for b, e in _bounds(dim, parts)]

    def as_list(array: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

    columns = {
        "first": as_list(first),
        "rows": as_list(rows),
        "dim": pa.array([dim], pa.int32()),
        "n": pa.array([len(points)], pa.int64()),
        "points": pa.array([points.tobytes()], pa.binary()),
        "places": pa.array([b"".join(order.tobytes() for order, _ in trees)], pa.binary()),
        "nodes": pa.array([b"".join(nodes.tobytes() for _, nodes in trees)], pa.binary()),
        "sizes": pa.array([[len(nodes) for _, nodes in trees]], pa.list_(pa.int32())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def blocks_of(
    vectors: DataFrame,
    carry: list[str] | None = None,
    id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """The kept vectors in stored blocks, each with the cover trees of its parts, the columns in
    ``carry`` (by default all) of its rows and its vectors of the smallest ids.

    A component ``x`` becomes ``floor(scale * x)``, within ``LARGEST``. Vectors of another length than
    most (of the longer of two lengths as frequent) are left out.
    """
    rows = kept(vectors, vector).select(
        F.struct(*(carry or vectors.columns)).alias("row"),
        F.col(id).alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
    )

    def put(batches: Batches) -> Batches:
        waiting: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def full(dim: int):
            own = waiting.pop(dim)
            sizes.pop(dim)
            own_rows, own_ids = (pa.concat_arrays([one[k] for one in own]) for k in (0, 1))
            return _block(dim, own_rows, own_ids, np.concatenate([p for _, _, p in own]), parts, entries)

        for part in batches:
            column = part.column("vector")
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                which = pa.array(np.flatnonzero(lengths == dim))
                values = column.take(which).flatten().to_numpy(zero_copy_only=False)
                whole = np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype("<i4")
                points = whole.reshape(len(which), dim)
                for at in range(0, len(which), block):
                    own = which[at : at + block]
                    taken = part.column("row").take(own), part.column("id").take(own), points[at : at + block]
                    waiting.setdefault(dim, []).append(taken)
                    sizes[dim] = sizes.get(dim, 0) + len(own)
                    if sizes[dim] >= block:
                        yield full(dim)
            if sum(sizes.values()) >= 2 * block:
                yield full(max(sizes, key=sizes.get))
        for dim in list(waiting):
            yield full(dim)

    schema = "dim int, n long, points binary, places binary, nodes binary, sizes array<int>"
    id_type, row_type = rows.schema["id"].dataType, rows.schema["row"].dataType
    first = F.array(F.struct(F.lit(None).cast(id_type).alias("id"), F.array().cast("array<int>").alias("vector")))
    first_type = rows.select(first.alias("first")).schema["first"].dataType
    stored = by_arrow(rows, put, schema, first=first_type, rows=ArrayType(row_type))
    blocks = materialize(stored, "vector-blocks")
    lengths = blocks.groupBy("dim").agg(F.sum("n").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    return blocks.filter(F.col("dim") == most["dim"]) if most else blocks


_STORED = ["dim", "n", "points", "places", "nodes", "sizes"]


class _Trees:
    """A block read back: for each part the points in the order of its tree, that order, the nodes."""

    def __init__(self, row: dict, parts: int):
        n, dim = row["n"], row["dim"]
        points = np.frombuffer(row["points"], "<i4").reshape(n, dim)
        places = np.frombuffer(row["places"], "<i4").reshape(parts, n)
        nodes = np.split(np.frombuffer(row["nodes"], cover_tree.NODE), np.cumsum(row["sizes"])[:-1])
        self.n = n
        self.parts = [(points[o][:, b:e], o, t) for (b, e), o, t in zip(_bounds(dim, parts), places, nodes)]


def _blocks(part: pa.RecordBatch):
    for k in range(part.num_rows):
        yield part.slice(k, 1).to_pylist()[0]


def first_codebooks(blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids; null ids come last, equal ids by vector."""
    first = blocks.select(F.explode("first").alias("first")).select("first.id", "first.vector")
    chosen = first.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not chosen:
        return [[] for _ in range(parts)]
    return [[list(r["vector"][b:e]) for r in chosen] for b, e in _bounds(len(chosen[0]["vector"]), parts)]


def next_codebooks(blocks: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts; unused ones stay."""
    books = [np.array(book, np.int64) for book in codebooks]
    types = {"part": pa.int32(), "entry": pa.int32(), "at": pa.int32(), "total": pa.int64()}

    def add(batches: Batches) -> Batches:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for part in batches:
            for row in _blocks(part):
                for k, (points, _, nodes) in enumerate(_Trees(row, len(books)).parts):
                    found, _ = cover_tree.assign(points, nodes, books[k])
                    count, total = cover_tree.sums(points, found, len(books[k]))
                    counts[k] += count
                    totals[k] += total
        cells = []
        for k, (count, total) in enumerate(zip(counts, totals)):
            for j in np.flatnonzero(count).tolist():
                cells.append((k, j, -1, int(count[j])))
                cells += [(k, j, at, value) for at, value in enumerate(total[j].tolist())]
        yield batch(dict(zip(types, map(list, zip(*cells)) if cells else [[]] * 4)), types)

    cells = by_arrow(blocks.select(*_STORED), add, "part int, entry int, at int, total long")
    sums = cells.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
    total = {(r["part"], r["entry"], r["at"]): r["total"] for r in sums.collect()}

    def moved(k: int, j: int, entry: list[int]) -> list[int]:
        count = total.get((k, j, -1))
        return [total[k, j, at] // count for at in range(len(entry))] if count else entry

    return [[moved(k, j, entry) for j, entry in enumerate(book)] for k, book in enumerate(codebooks)]


def fit(blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds from the vectors of the smallest ids."""
    codebooks = first_codebooks(blocks, parts, entries)
    for _ in range(rounds if codebooks[0] else 0):
        codebooks = next_codebooks(blocks, codebooks)
    return codebooks


def encode(blocks: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Each vector of the blocks: ``row`` (the columns carried), ``code`` (the index of the nearest
    entry of each part, two hexadecimal digits each) and ``error`` (its squared distance to them)."""
    books = [np.array(book, np.int64) for book in codebooks]
    digits = np.array([f"{j:02x}" for j in range(256)])

    def code(batches: Batches) -> Batches:
        for part in batches:
            for place, row in enumerate(_blocks(part.select(_STORED))):
                trees = _Trees(row, len(books))
                error = np.zeros(trees.n, np.int64)
                codes = np.empty((trees.n, len(books)), np.int64)
                for k, (points, order, nodes) in enumerate(trees.parts):
                    found, _ = cover_tree.assign(points, nodes, books[k])
                    away = points - books[k][found]
                    error[order] += (away * away).sum(axis=1)
                    codes[order, k] = found
                own = part.column("rows").slice(place, 1).flatten()
                written = ["".join(one) for one in digits[codes].tolist()]
                columns = [own, pa.array(written, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "code", "error"])

    row_type = blocks.schema["rows"].dataType.elementType
    return by_arrow(blocks.select("rows", *_STORED), code, "code string, error long", row=row_type)


def compress(vectors: DataFrame, carry: list[str] | None = None, **settings) -> tuple[DataFrame, Codebooks]:
    """Codes of all kept vectors, see ``encode``, and the codebooks.

    Rows whose vector is null or holds null, NaN or infinite components are dropped, see ``kept``; so
    are vectors of another length than most. Rows may repeat and ids may be null. Fewer vectors than
    entries give as many entries; without vectors there are no rows and no entries.
    """
    own = {name: settings[name] for name in ("parts", "entries") if name in settings}
    rounds = settings.pop("rounds", ROUNDS)
    blocks = blocks_of(vectors, carry, **settings)
    codebooks = fit(blocks, rounds=rounds, **own)
    return encode(blocks, codebooks), codebooks


def with_label_error(coded: DataFrame, label: str) -> DataFrame:
    """The rows with ``label_error``: ``error`` summed over equal labels, nulls together. Summed before
    the join, so that a label of very many rows meets in no task."""
    stored = materialize(coded, "codes")
    of_row = F.col(f"row.{label}")
    sums = stored.groupBy(of_row.alias("of_label")).agg(F.sum("error").alias("label_error"))
    sums = sent_if_small(materialize(sums, "label-errors"))
    return stored.join(sums, of_row.eqNullSafe(F.col("of_label"))).drop("of_label")

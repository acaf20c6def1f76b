"""Alignment of two tokenizers on the same text: groups of tokens between common byte offsets.

*Units.* Neither tokenizer joins anything across a single space between two characters that are no
white space. Texts are cut there; a unit is what lies between two cuts, with the space before it.
Both tokenizers end a token at each cut, so a cut is a common offset, and the tokens of a unit hold
wherever it occurs. A Python worker keeps those of many units.

*Fragments.* A chunk of a text knows nothing of its neighbours. It is an open prefix (text before
its first cut), closed groups (the tokens of the units between its first and last cut) and an open
suffix, or, without a cut, open text alone. ``join`` of neighbours tokenises the units that form where
suffix and prefix meet. It is associative and the empty open text is neutral, so the chunks of a very
long text are spread over tasks, and a tree of shuffles, ``FAN`` chunks to a node, puts each text
together. Texts of up to ``CHUNK`` characters are a single chunk and need no shuffle.

*Counts.* Texts are tokenised once; their ids are stored, two bytes a token. The pairs of ids that a
text links are counted over all texts, once for each text: within tasks first, then by one shuffle of
pairs. Frequent pairs, ``HEAD_PAIRS`` at most, are sent to all tasks; links of all other pairs are
joined with their counts.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.llm.common import Batches, batch, by_arrow, text_of
from coinbrook.llm.token_bytes import tokenizer
from coinbrook.sinks.scratch import materialize

#: Vocabulary files; neither is part of the package.
FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a text that one task tokenises; longer texts are dealt out in chunks.
CHUNK = 1 << 15
#: Neighbouring fragments that one node of the tree joins.
FAN = 8
#: Pairs whose counts are sent to all tasks, 17 bytes each.
HEAD_PAIRS = 1 << 20
#: What a Python worker keeps: units, and characters of units.
UNITS, UNIT_CHARS = 1 << 18, 1 << 24
#: Counts of pairs that a task holds before it passes them on.
TASK_PAIRS = 1 << 20
#: Bytes of text, and of the first tokenizer's ids, that a task handles at a time.
BATCH_CHARS, BATCH_IDS = 1 << 20, 1 << 18
#: Groups of more links than this are counted by distinct ids instead of being written out.
WIDE_GROUP = 1 << 12

#: A cut: one space between characters that are no white space. The space goes to the unit after it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A pair of ids as one long, and the place of the text in a batch before it.
SHIFT, TEXT_SHIFT = 21, 42


class Units:
    """Ids of units by both tokenizers, as bytes. Units that either tokenizer does not give back in
    their own bytes are ``odd``."""

    def __init__(self, first: str, second: str):
        self.tokenizers = tokenizer(first), tokenizer(second)
        self.codes = ["H" if len(t.bytes) <= 1 << 16 else "I" for t in self.tokenizers]
        self.sizes = [np.array([len(b) for b in t.bytes], np.int64) for t in self.tokenizers]
        #: The bytes of all ids one after the other, and where each begins.
        self.tables = [np.frombuffer(b"".join(t.bytes), np.uint8) for t in self.tokenizers]
        self.begins = [np.cumsum(s) - s for s in self.sizes]
        self._known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self._odd: set[str] = set()
        self._chars = 0

    def learn(self, units: set[str]) -> None:
        """Make all of ``units`` known; others may be forgotten."""
        known = self._known[0]
        new = [u for u in units if u not in known]
        if len(known) + len(new) > UNITS or self._chars > UNIT_CHARS:
            for own in (*self._known, self._odd):
                own.clear()
            self._chars = 0
            new = list(units)
        if not new:
            return
        spaced = [" " + u for u in new]
        self._chars += sum(map(len, spaced))
        same = True
        for which, (known, code) in enumerate(zip(self._known, self.codes)):
            ids = self.tokenizers[which].encode(spaced)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
            same = same and self._given_back(spaced, which, counts, flat)
            packed, width = flat.astype(code).tobytes(), np.dtype(code).itemsize
            ends = (width * np.cumsum(counts)).tolist()
            known.update(zip(new, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        if not same:
            self._odd.update(u for u, text in zip(new, spaced) if not self._is_given_back(u, text))

    def _given_back(self, texts: list[str], which: int, counts: np.ndarray, flat: np.ndarray) -> bool:
        """Do the tokens of all texts have their bytes, and do they end where the texts end?"""
        sizes, begins, table = self.sizes[which], self.begins[which], self.tables[which]
        ends = np.cumsum(sizes[flat])
        wanted = np.frombuffer("".join(texts).encode(), np.uint8)
        if len(wanted) != (ends[-1] if len(ends) else 0):
            return False
        own = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        if not np.array_equal(np.concatenate([[0], ends])[np.cumsum(counts)], np.cumsum(own)):
            return False
        places = np.repeat(begins[flat] - ends + sizes[flat], sizes[flat]) + np.arange(len(wanted))
        return np.array_equal(table[places], wanted)

    def _is_given_back(self, unit: str, text: str) -> bool:
        own = text.encode()
        return all(
            b"".join([t.bytes[k] for k in np.frombuffer(known[unit], code)]) == own
            for t, known, code in zip(self.tokenizers, self._known, self.codes)
        )

    def ids(self, units: list[str]) -> tuple[bytes, bytes] | None:
        """The ids of neighbouring units, which must be known; None if one of them is odd."""
        if self._odd and not self._odd.isdisjoint(units):
            return None
        a, b = (b"".join(map(known.__getitem__, units)) for known in self._known)
        return a, b


@functools.cache
def _units(first: str, second: str) -> Units:
    return Units(first, second)


# -- fragments -----------------------------------------------------------------------------

_NO_IDS = (b"", b"")


def _closed(units: list[str], store: Units) -> tuple[bytes, bytes] | None:
    store.learn(set(units))
    return store.ids(units)


def _then(*parts: tuple[bytes, bytes] | None) -> tuple[bytes, bytes] | None:
    if None in parts:
        return None
    return b"".join([a for a, _ in parts]), b"".join([b for _, b in parts])


@dataclass(frozen=True)
class Fragment:
    """Neighbouring chunks of a text: open prefix, closed groups, open suffix. Groups are kept as the
    ids that they consist of; None if a unit among them has no tokens of the right bytes. Where there
    is no cut, ``prefix`` is all of the text and ``suffix`` is None."""

    prefix: str = ""
    groups: tuple[bytes, bytes] | None = _NO_IDS
    suffix: str | None = None

    @staticmethod
    def of(text: str, store: Units) -> Fragment:
        units = CUT.split(text)
        if len(units) == 1:
            return Fragment(text)
        return Fragment(units[0], _closed(units[1:-1], store), units[-1])

    def join(self, other: Fragment, store: Units) -> Fragment:
        """The fragment of both, this one being to the left. The text between the last cut of the one
        and the first cut of the other is open at an end where there is no such cut."""
        if self.suffix is None and other.suffix is None:
            return Fragment.of(self.prefix + other.prefix, store)
        if self.suffix is None:
            units = CUT.split(self.prefix + other.prefix)
            return replace(other, prefix=units[0], groups=_then(_closed(units[1:], store), other.groups))
        units = CUT.split(self.suffix + other.prefix)
        if other.suffix is None:
            return replace(self, groups=_then(self.groups, _closed(units[:-1], store)), suffix=units[-1])
        between = _closed(units, store)
        return Fragment(self.prefix, _then(self.groups, between, other.groups), other.suffix)

    def whole(self, store: Units) -> tuple[bytes, bytes] | None:
        """The ids of a text of which this is all; the empty text has none."""
        if self.suffix is None:
            return _closed([self.prefix], store) if self.prefix else _NO_IDS
        return _then(_closed([self.prefix], store), self.groups, _closed([self.suffix], store))


# -- ids of all texts ----------------------------------------------------------------------

def _small(batches: Batches, column: str, most: int) -> Batches:
    """The batches in slices that hold ``most`` bytes in a column, or one longer text."""
    for part in batches:
        sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield part.slice(begin, k - begin)
                begin, held = k, 0
            held += size
        yield part.slice(begin)


_IDS_DDL = "a binary, b binary"


def _with_ids(columns: dict[str, pa.Array], ids: list[tuple[bytes, bytes] | None]) -> pa.RecordBatch:
    """Texts that are not given back have no tokens."""
    columns["a"] = pa.array([(one or _NO_IDS)[0] for one in ids], pa.binary())
    columns["b"] = pa.array([(one or _NO_IDS)[1] for one in ids], pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _short_ids(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Texts of a single chunk with their ids."""

    def tokenise(batches: Batches) -> Batches:
        store = _units(first, second)
        for part in _small(batches, "text", BATCH_CHARS):
            texts = [CUT.split(t) if t else [] for t in part.column("text").to_pylist()]
            store.learn(set().union(*texts))
            yield _with_ids({"row": part.column("row")}, [store.ids(units) for units in texts])

    return by_arrow(rows, tokenise, _IDS_DDL, row=rows.schema["row"].dataType)


def _chunks(long_texts: DataFrame, chunk: int) -> DataFrame:
    """The texts in chunks of ``chunk`` characters, with the number of each; the row with the first."""

    def cut(batches: Batches) -> Batches:
        for part in batches:
            for k in range(part.num_rows):
                text, one = part.column("text")[k].as_py(), part.slice(k, 1)
                for no, begin in enumerate(range(0, len(text), chunk)):
                    row = one.column("row") if no == 0 else pa.nulls(1, one.column("row").type)
                    own = [row, one.column("key"), pa.array([no]), pa.array([text[begin : begin + chunk]])]
                    yield pa.RecordBatch.from_arrays(own, names=["row", "key", "no", "text"])

    keyed = long_texts.withColumn("key", F.monotonically_increasing_id())
    return by_arrow(keyed, cut, "key long, no long, text string", row=long_texts.schema["row"].dataType)


_FRAGMENT = {
    "key": pa.int64(),
    "no": pa.int64(),
    "prefix": pa.string(),
    "a": pa.binary(),
    "b": pa.binary(),
    "suffix": pa.string(),
}
_FRAGMENT_DDL = "key long, no long, prefix string, a binary, b binary, suffix string"


def _rows(batches: Batches) -> Iterator[dict]:
    return (row for part in batches for k in range(part.num_rows) for row in part.slice(k, 1).to_pylist())


def _fragment_row(key: int, no: int, one: Fragment) -> pa.RecordBatch:
    a, b = one.groups or (None, None)
    values = (key, no, one.prefix, a, b, one.suffix)
    return batch({name: [value] for name, value in zip(_FRAGMENT, values)}, _FRAGMENT)


def _fragment(row: dict) -> Fragment:
    groups = None if row["a"] is None else (row["a"], row["b"])
    return Fragment(row["prefix"], groups, row["suffix"])


def _fragments(chunks: DataFrame, first: str, second: str) -> DataFrame:
    def tokenise(batches: Batches) -> Batches:
        store = _units(first, second)
        for row in _rows(batches):
            yield _fragment_row(row["key"], row["no"], Fragment.of(row["text"], store))

    dealt = chunks.select("key", "no", "text").repartition("key", "no")
    return by_arrow(dealt, tokenise, _FRAGMENT_DDL)


def _joined(fragments: DataFrame, fan: int, first: str, second: str) -> DataFrame:
    """One level of the tree: each ``fan`` neighbours as one fragment."""

    def fold(batches: Batches) -> Batches:
        store = _units(first, second)
        at, whole = None, Fragment()
        for row in _rows(batches):
            own = row["key"], row["no"] // fan
            if own != at:
                if at is not None:
                    yield _fragment_row(*at, whole)
                at, whole = own, _fragment(row)
            else:
                whole = whole.join(_fragment(row), store)
        if at is not None:
            yield _fragment_row(*at, whole)

    node = F.expr(f"no div {fan}")
    placed = fragments.repartition("key", node).sortWithinPartitions("key", "no")
    return by_arrow(placed, fold, _FRAGMENT_DDL)


def _long_ids(chunks: DataFrame, fan: int, first: str, second: str) -> DataFrame | None:
    """Texts of stored chunks with their ids; None without any."""
    highest = chunks.agg(F.max("no")).first()[0]
    if highest is None:
        return None
    nodes, fragments = highest + 1, _fragments(chunks, first, second)
    while nodes > 1:
        fragments = _joined(fragments, fan, first, second)
        nodes = -(-nodes // fan)

    def close(batches: Batches) -> Batches:
        store = _units(first, second)
        for row in _rows(batches):
            yield _with_ids({"key": pa.array([row["key"]], pa.int64())}, [_fragment(row).whole(store)])

    ids = by_arrow(fragments, close, f"key long, {_IDS_DDL}")
    return chunks.filter("no = 0").select("row", "key").join(ids, "key").select("row", "a", "b")


# -- groups and links ----------------------------------------------------------------------


class _Aligned:
    """The groups of a batch of texts, tokens of all texts in one row of numbers.

    Both tokenizers cover each text, so their offsets keep in step from text to text. ``group_a`` and
    ``group_b`` are the groups of the tokens, ``first_a`` and ``first_b`` the first tokens of the
    groups, each with the number of all tokens at its end.
    """

    def __init__(self, part: pa.RecordBatch, store: Units):
        texts = [part.column(c).to_pylist() for c in ("a", "b")]
        self.ids, counts, ends = [], [], []
        for own, code, sizes in zip(texts, store.codes, store.sizes):
            ids = np.frombuffer(b"".join(own), code).astype(np.int64)
            self.ids.append(ids)
            counts.append(np.array([len(t) // array(code).itemsize for t in own], np.int64))
            ends.append(np.cumsum(sizes[ids]))
        self.n_a, self.n_b = counts
        common = np.intersect1d(*ends, assume_unique=True)
        self.group_a, self.group_b = (np.searchsorted(common, e) for e in ends)
        self.first_a, self.first_b = (
            np.concatenate([[0], np.searchsorted(e, common, side="right")]) for e in ends
        )
        #: Number of groups before each text, and of all.
        last = np.concatenate([[0], np.cumsum(self.n_a)])
        self.groups_before = np.searchsorted(self.first_a, last)
        self.n_groups = np.diff(self.groups_before)
        text_of_group = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        self.links_of_group = np.diff(self.first_a) * np.diff(self.first_b)
        self.n_links = np.bincount(text_of_group, self.links_of_group, len(self.n_a)).astype(np.int64)
        self._text_of_group = text_of_group

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each text: text, pair, number of its links; by text and pair."""
        a, b = self.ids
        wide = self.links_of_group > WIDE_GROUP
        times = np.where(wide, 0, np.diff(self.first_b))[self.group_a]
        partner = np.repeat(self.first_b[self.group_a] - np.cumsum(times) + times, times)
        partner += np.arange(len(partner))
        keys = np.repeat(self._text_of_group[self.group_a] << TEXT_SHIFT | a << SHIFT, times) | b[partner]
        keys, links = np.unique(keys, return_counts=True)
        if wide.any():
            more = [self._wide_pairs(g) for g in np.flatnonzero(wide)]
            both = np.concatenate([keys, *[k for k, _ in more]])
            keys, place = np.unique(both, return_inverse=True)
            weights = np.concatenate([links, *[n for _, n in more]])
            links = np.zeros(len(keys), np.int64)
            np.add.at(links, place, weights)
        return keys >> TEXT_SHIFT, keys & ((1 << TEXT_SHIFT) - 1), links

    def _wide_pairs(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        (a, times_a), (b, times_b) = (
            np.unique(ids[first[g] : first[g + 1]], return_counts=True)
            for ids, first in zip(self.ids, (self.first_a, self.first_b))
        )
        keys = (self._text_of_group[g] << TEXT_SHIFT | a << SHIFT)[:, None] | b[None, :]
        return keys.ravel(), (times_a[:, None] * times_b[None, :]).ravel()

    def texts(self, names: _Names) -> list[str]:
        """The groups of each text, written out."""
        a, b = self.ids
        pieces = np.empty(len(a) + len(b), object)
        last_a = np.zeros(len(a), np.int64)
        last_a[self.first_a[1:] - 1] = 1
        last_b = np.zeros(len(b), np.int64)
        last_b[self.first_b[1:] - 1] = 1
        # The tokens of a group stand together, those of the first tokenizer before the others.
        pieces[np.arange(len(a)) + self.first_b[self.group_a]] = names.first[last_a, a]
        pieces[np.arange(len(b)) + self.first_a[self.group_b + 1]] = names.second[last_b, b]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(pieces[begin:end])[:-1] for begin, end in zip([0, *ends], ends)]


class _Names:
    """How ids are written within a group and at its end."""

    def __init__(self, store: Units):
        self.first, self.second = (
            np.array([[f"{k}{mark}" for k in range(len(t.bytes))] for mark in marks], object)
            for t, marks in zip(store.tokenizers, (",|", ",;"))
        )


@functools.cache
def _names(first: str, second: str) -> _Names:
    return _Names(_units(first, second))


def _count_pairs(encoded: DataFrame, first: str, second: str) -> DataFrame:
    """For each pair that texts link, in how many of them; summed over ``TASK_PAIRS`` counts at a
    time."""
    types = {"pair": pa.int64(), "docs": pa.int64()}

    def count(batches: Batches) -> Batches:
        store = _units(first, second)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, place = np.unique(np.concatenate([p for p, _ in waiting]), return_inverse=True)
            docs = np.zeros(len(pairs), np.int64)
            np.add.at(docs, place, np.concatenate([n for _, n in waiting]))
            return pairs, docs

        for part in _small(batches, "a", BATCH_IDS):
            _, pairs, _ = _Aligned(part, store).pairs()
            waiting.append(np.unique(pairs, return_counts=True))
            if sum(len(p) for p, _ in waiting) > TASK_PAIRS:
                waiting[:] = [summed()]
                if len(waiting[0][0]) > TASK_PAIRS // 2:
                    pairs, docs = waiting.pop()
                    yield batch({"pair": pa.array(pairs), "docs": pa.array(docs)}, types)
        if waiting:
            pairs, docs = summed()
            yield batch({"pair": pa.array(pairs), "docs": pa.array(docs)}, types)

    return by_arrow(encoded.select("a", "b"), count, "pair long, docs long")


class _Head:
    """Counts of the frequent pairs, in order of pair, for look-up by arrays."""

    def __init__(self, pairs: np.ndarray, docs: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.docs, self.best = pairs[order], docs[order], best[order]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair: is it here, its count, and is that the highest of its first id (else 0)."""
        if not len(self.pairs):
            nothing = np.zeros(len(pairs), np.int64)
            return nothing.astype(bool), nothing, nothing
        place = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        here = self.pairs[place] == pairs
        return here, np.where(here, self.docs[place], 0), np.where(here, self.best[place], 0)


def _head(counts: DataFrame, most: int) -> tuple[_Head, bool]:
    """The pairs of the highest counts, by whole powers of two, ``most`` at most, and whether these
    are all."""
    level = F.floor(F.log2("docs")).alias("level")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level).count().collect()}
    taken, least = 0, None
    for k in sorted(sizes, reverse=True):
        if taken + sizes[k] > most:
            break
        taken, least = taken + sizes[k], k
    chosen = counts.filter(F.lit(False) if least is None else F.col("docs") >= 2**least)
    table = chosen.select("pair", "docs", F.col("best").cast("byte").alias("best")).toArrow()
    head = _Head(*[table.column(k).to_numpy() for k in ("pair", "docs", "best")])
    return head, taken == sum(sizes.values())


_SCORED_DDL = (
    "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, "
    "tail_pairs array<long>, tail_links array<long>"
)


def _score(encoded: DataFrame, first: str, second: str, head, digest: bool) -> DataFrame:
    """The texts with their groups and the sums over the pairs of the head."""

    def score(batches: Batches) -> Batches:
        store, names = _units(first, second), _names(first, second)
        for part in _small(batches, "a", BATCH_IDS):
            own = _Aligned(part, store)
            texts = own.texts(names)
            if digest:
                texts = [hashlib.sha256(t.encode()).hexdigest() if t else t for t in texts]
            text, pairs, links = own.pairs()
            here, docs, best = head.value.find(pairs)
            n_best, count_sum = np.zeros((2, part.num_rows), np.int64)
            np.add.at(n_best, text, links * best)
            np.add.at(count_sum, text, links * docs)
            tail = np.flatnonzero(~here)
            starts = pa.array(np.searchsorted(text[tail], np.arange(part.num_rows + 1)).astype(np.int32))
            sums = [own.n_a, own.n_b, own.n_groups, own.n_links, n_best, count_sum]
            columns = [part.column("row"), *[pa.array(x.astype(np.int64)) for x in sums], pa.array(texts, pa.string())]
            columns += [pa.ListArray.from_arrays(starts, pa.array(x[tail])) for x in (pairs, links)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *re.findall(r"(\w+) (?:long|string|array)", _SCORED_DDL)])

    return by_arrow(encoded, score, _SCORED_DDL, row=encoded.schema["row"].dataType)


def align(
    docs: DataFrame,
    carry: list[str] | None = None,
    text: str = "text",
    first: str = FIRST,
    second: str = SECOND,
    digest: bool = False,
    chunk: int = CHUNK,
    fan: int = FAN,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """Every row of ``docs`` with the alignment of its tokens by ``first`` and by ``second``.

    Returns ``row`` (a struct of the columns in ``carry``, by default all), ``n_a`` and ``n_b``
    (tokens), ``n_groups``, ``n_links`` (pairs of tokens of one group), ``n_best`` (links whose pair
    of ids has the highest count of its first id, ties included), ``count_sum`` (counts summed over
    the links) and ``groups``: ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256. The count of a
    pair is the number of rows whose texts link it; equal rows count each. Texts that are null or
    empty, and texts that either tokenizer does not give back byte by byte, have zeros, an empty
    ``groups``, and count for nothing. Rows may repeat, and no column is taken for a key. Vocabularies
    may hold up to two million ids.
    """
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), text_of(text).alias("text"))
    is_long = F.length("text") > chunk
    encoded = _short_ids(rows.filter(~is_long), first, second)
    long_ids = _long_ids(materialize(_chunks(rows.filter(is_long), chunk), "chunks"), fan, first, second)
    encoded = materialize(encoded if long_ids is None else encoded.unionByName(long_ids), "token-ids")
    summed = _count_pairs(encoded, first, second).groupBy("pair").agg(F.sum("docs").alias("docs"))
    # A window holds the pairs of one first id: at most as many as the second vocabulary has ids.
    own = Window.partitionBy(F.shiftright("pair", SHIFT))
    counts = materialize(summed.withColumn("best", F.col("docs") == F.max("docs").over(own)), "pairs")
    frequent, all_of_them = _head(counts, head_pairs)
    scored = _score(encoded, first, second, docs.sparkSession.sparkContext.broadcast(frequent), digest)
    if not all_of_them:
        scored = _with_tail(scored, counts)
    return scored.drop("tail_pairs", "tail_links")


def _with_tail(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Add what the links outside the head bring."""
    keyed = materialize(scored.withColumn("key", F.monotonically_increasing_id()), "scored")
    tail = keyed.select("key", F.explode(F.arrays_zip("tail_pairs", "tail_links")).alias("tail"))
    tail = tail.select("key", F.col("tail.tail_pairs").alias("pair"), F.col("tail.tail_links").alias("links"))
    more = tail.join(counts, "pair").groupBy("key")
    more = more.agg(
        F.sum(F.when(F.col("best"), F.col("links"))).alias("more_best"),
        F.sum(F.col("links") * F.col("docs")).alias("more_sum"),
    )
    both = keyed.join(more, "key", "left")
    return both.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
        }
    ).drop("key", "more_best", "more_sum")

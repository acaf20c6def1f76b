"""Line deduplication by an exact set-similarity join, in DataFrame operations.

A line is the set of its words. Two lines match when the Jaccard similarity of their sets is at least
0.8; a line that matches an earlier one (by doc_id, then by line) is removed.

1. Lines of equal text (in lower case) match. Only the first of them goes on.
2. *Parts.* Sets of n and m words that match differ in (n + m) div 9 words at most, so in n div 4 words,
   m being at most 1.25 n. The words are dealt into parts by their hash. A part is broken where the sets
   differ in it; so of 2^c parts, 2^c - d are the same in both if they differ in d words.
   There are 2^c parts for sets of fewer than 3 * 2^c words, which makes about two to three words a part.
   A set that may match smaller ones with half as many parts is dealt into these as well.
3. *Prefix filter* over the parts. They are ordered by weight, the heaviest first: long words weigh more, since
   they are rarer, and a part weighs as much as its words together. Of d + 2 parts at the head of this
   order, two are common to both sets, or the first common one is among the first d + 1. So heavy parts
   (``RARE``) are keys by themselves and light ones in pairs: every match shares a key. The weights decide
   how many lines meet under a key, never which lines match.
4. *Length filter* and a bound from parities are applied where lines meet under a key: the sizes must
   allow the similarity, and the parities of the words' hashes can differ in no more places than the
   sets differ in words. They have 64 places, and 128 where both lines have more than ``WIDE`` words,
   since 64 places of such lines tell little.
5. Under keys of up to ``GROUP`` lines all of them meet. Under a larger key, lines are compared with its
   earliest line first, which settles most; lines that have found no earlier match then are compared
   with all earlier lines of the key.
6. The similarity of the candidates is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coinbrook.llm.common import sent_if_small, text_of, unused
from coinbrook.sinks.scratch import materialize

#: Similarity as a fraction of whole numbers.
SHARED, OF = 4, 5
#: Parts of this weight are keys of their own.
RARE = 9
#: Lines that are compared with each other under one key.
GROUP = 64
#: Places of the table of weights, four bits each.
PLACES = 16
#: Weight of words by length: bytes beyond the first, 8 at most.
WEIGHTS = [sum(min(max(n - 1, 0), 8) << 4 * n for n in range(PLACES - 1)) - (8 << 60)]
SETTLING_ROUNDS = 3
#: Lines of more words have parities of 128 places.
WIDE = 112
#: Bits of a part's hash that stay beside its weight.
_HASH_BITS = 57


def lines_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, line (from 0), further columns, and ``words`` (in lower case, with a space between) of
    every line, and ``set``, a hash of them; null for a line without words."""
    text = F.lower(text_of())
    for space in ("\t", "\x0b", "\f", "\r"):
        text = F.replace(text, F.lit(space), F.lit(" "))
    lines = docs.select("doc_id", *more, F.posexplode(F.split(text, "\n")).alias("line", "_text"))
    words = F.trim("_text")
    lines = lines.withColumn("words", F.when(words != "", words)).drop("_text")
    return lines.withColumn("set", F.when(F.col("words").isNotNull(), F.xxhash64(F.lit(1), "words")))


#: The words of a line; a word can occur more than once.
_WORDS = "array_remove(split(words, ' '), '')"


def _place(*more: str) -> Column:
    """Lines in order: by doc_id, those without one last, then by line."""
    return F.struct(
        F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("line").alias("line"), *more
    )


# -- keys ----------------------------------------------------------------------------------


def _parts(shift: str) -> str:
    """SQL: the parts, other than empty ones, of the words ``w`` dealt into 2^(64 - shift), as numbers that sort the heaviest first.

    Words are sorted by hash, so those of a part lie side by side. The first three tell parts apart well enough.
    """
    apart = f"shiftrightunsigned(x ^ coalesce(get(w, i + {{}}), ~x), {shift}) != 0"
    second, third = "get(w, i + 1)", "get(w, i + 2)"

    def number(content: str, *words: str) -> str:
        weight = " - ".join(f"({x} & 15L)" for x in words)
        return f"shiftleft(62L - {weight}, {_HASH_BITS}) | ({content} & {(1 << _HASH_BITS) - 1}L)"

    return f"""sort_array(filter(transform(w, (x, i) -> if({apart.format(-1)},
        if({apart.format(1)}, {number("shiftright(x, 4)", "x")},
        if({apart.format(2)}, {number(f"xxhash64(x, {second})", "x", second)},
        {number(f"xxhash64(x, {second}, {third})", "x", second, third)})), -1L)), x -> x >= 0))"""


def _filled(parts: str, c: str, d: str) -> str:
    """SQL: the parts, followed by empty ones where there are fewer than d + 2."""
    empty = f"array_except(sequence(0L, shiftleft(1L, {c}) - 1), transform(w, x -> shiftrightunsigned(x, 64 - {c})))"
    number = f"shiftleft(63L, {_HASH_BITS}) | (xxhash64({c}, p) & {(1 << _HASH_BITS) - 1}L)"
    return f"""if(size({parts}) >= {d} + 2, {parts},
        concat({parts}, transform(slice({empty}, 1, {d} + 2 - size({parts})), p -> {number})))"""


def _prefix_keys(parts: str, d: str, heavy: str) -> str:
    """SQL: keys from the first parts, the first ``heavy`` of which are heavy; where that is more than d, these are enough."""
    return f"""if({heavy} > {d}, slice({parts}, 1, {d} + 1),
        concat(slice({parts}, 1, {heavy}), flatten(transform(slice({parts}, {heavy} + 1, {d} + 2 - {heavy}), (x, i) ->
            transform(slice({parts}, {heavy} + i + 2, {d} + 1 - {heavy} - i), y -> xxhash64(x, y))))))"""


def keys_of(lines: DataFrame, table: list[int] = WEIGHTS) -> DataFrame:
    """``key``, ``set``, ``n``, ``parity`` and ``half`` of the lines; ``table`` has the weights of words by length.

    ``half`` is the parity of the words in the second half of the 128 places, 0 for lines that are not wide.

    Lines of under four words match equal sets only, so their key is the whole set.
    """
    weight = f"(shiftrightunsigned({table[0]}L, 4 * least(octet_length(w), {PLACES - 1})) & 15L)"
    words = f"sort_array(array_distinct(transform({_WORDS}, w -> (xxhash64(w) & ~15L) | {weight})))"
    place = "int(shiftright(x, 4) & 63L)"
    flip = f"shiftleft(shiftright(x, 10) & 1L, {place})"
    sets = lines.select("set", F.expr(words).alias("w")).select(
        "set",
        "w",
        F.size("w").alias("n"),
        # The least c of at least 2 with n < 3 * 2^c.
        F.expr("greatest(2, length(bin(size(w) div 3)))").alias("c"),
    )
    sets = sets.select("*", F.expr("64 - c").alias("shift"), F.expr("65 - c").alias("shift2"))
    sets = sets.select(
        "*",
        F.expr(f"aggregate(w, 0L, (p, x) -> p ^ shiftleft(1L, {place}))").alias("parity"),
        F.expr(f"if(n > {WIDE}, aggregate(w, 0L, (p, x) -> p ^ {flip}), 0L)").alias("half"),
        F.expr("n div 4").alias("d"),
        F.expr(_parts("shift")).alias("parts"),
        # Words at most in smaller sets with half as many parts.
        F.expr("if(c > 2, shiftleft(3, c - 1) - 1, 0)").alias("below"),
    )
    sets = sets.select("*", F.expr("if(4 * n <= 5 * below, (n + below) div 9, null)").alias("d2"))
    sets = sets.select("*", F.expr(f"if(d2 is null, null, {_parts('shift2')})").alias("parts2"))
    sets = sets.withColumn("parts", F.expr(_filled("parts", "c", "d")))
    sets = sets.withColumn("parts2", F.expr(f"if(d2 is null, null, {_filled('parts2', '(c - 1)', 'd2')})"))
    heavy = f"size(filter(slice({{}}, 1, {{}} + 2), x -> x < {max(63 - RARE, 0) << _HASH_BITS}L))"
    sets = sets.select(
        "*",
        F.expr(heavy.format("parts", "d")).alias("heavy"),
        F.expr(f"if(d2 is null, 0, {heavy.format('parts2', 'd2')})").alias("heavy2"),
    )
    keys = f"""if(n < 4, array(xxhash64(3, w)), if(d2 is null, {_prefix_keys("parts", "d", "heavy")},
        array_distinct(concat({_prefix_keys("parts", "d", "heavy")}, {_prefix_keys("parts2", "d2", "heavy2")}))))"""
    return sets.select(F.explode(F.expr(keys)).alias("key"), *_OF_LINE)


#: What a line brings to a key, besides the key.
_OF_LINE = ("set", "parity", "n", "half")


def may_match() -> str:
    """SQL: length filter and the bounds from parities, for a line and one with names in 2."""
    overlap = "((4 * (n + n2) + 8) div 9)"
    return f"""5 * least(n, n2) >= 4 * greatest(n, n2)
        AND bit_count(parity ^ parity2) <= n + n2 - 2 * {overlap}
        AND (least(n, n2) <= {WIDE}
            OR bit_count(half ^ half2) + bit_count(parity ^ half ^ parity2 ^ half2) <= n + n2 - 2 * {overlap})"""


def _meetings(keys: DataFrame) -> DataFrame:
    """Pairs of lines ``a``, ``b`` that meet under a key; and the lines of large keys, whose ``a`` is null.

    The keys are shuffled once. Lines that share one are put together where they are, those of large keys one by one.
    """
    counted = keys.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1")
    large = F.col("c") > GROUP
    alone = F.when(large, F.col("set")).alias("alone")
    groups = counted.groupBy("key", alone).agg(F.collect_list(F.struct(*_OF_LINE)).alias("lines"), F.any_value(large).alias("large"))
    groups = materialize(groups, "groups")
    small = groups.filter("not large").select("lines", F.inline("lines"))
    pairs = small.select(*_OF_LINE, F.inline("lines").alias(*[f"{c}2" for c in _OF_LINE]))
    pairs = pairs.filter(F.expr(f"set < set2 AND {may_match()}"))
    pairs = pairs.select(F.col("set").alias("a"), F.col("set2").alias("b")).distinct()
    large = groups.filter("large").select("key", F.inline("lines"))
    return pairs.unionByName(large, allowMissingColumns=True)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end; their results are stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# -- matches -------------------------------------------------------------------------------


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The later set of each stored pair ``a``, ``b`` whose similarity is high enough.

    Only the words of sets in the pairs are shuffled.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    held = held.join(sent_if_small(materialize(needed, "needed-sets")), "set", "left_semi")
    # Words travel as text, which is a fraction of the size of an array. Their array stands in one place, since
    # Spark works it out wherever it stands.
    columns = ("set", "words", "n", "place")
    first = held.select(*[F.col(c).alias(x) for c, x in zip(columns, ("a", "wa", "na", "pa"), strict=True)])
    second = held.select(*[F.col(c).alias(x) for c, x in zip(columns, ("b", "wb", "nb", "pb"), strict=True)])
    both = pairs.join(first, "a").join(second, "b")
    shared = F.size(F.array_intersect(*[F.expr(_WORDS.replace("words", c)) for c in ("wa", "wb")]))
    similar = (SHARED + OF) * shared >= SHARED * (F.col("na") + F.col("nb"))
    later = F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b"))
    return both.filter(similar).select(later.alias("set")).distinct()


def _open_pairs(lines: DataFrame, earlier: DataFrame) -> DataFrame:
    """Stored pairs of lines with earlier ones under the same key that pass the filters."""
    other = earlier.select("key", *[F.col(c).alias(f"{c}2") for c in (*_OF_LINE, "place")])
    met = lines.join(other, "key").filter(F.expr(f"place2 < place AND set != set2 AND {may_match()}"))
    return materialize(met.select(F.col("set").alias("a"), F.col("set2").alias("b")).distinct(), "open-pairs")


def _settled_in_large(large: DataFrame, held: DataFrame, settled: DataFrame) -> DataFrame:
    """Sets with an earlier match under a large key. ``settled`` are known to have one."""
    lines = materialize(large.join(held.select("set", "place"), "set"), "large-keys")
    still = materialize(lines.join(sent_if_small(settled), "set", "left_anti"), "open-lines")
    used = None
    for turn in range(SETTLING_ROUNDS + 1):
        waiting = still if used is None else still.join(sent_if_small(used), ["key", "set"], "left_anti")
        first = F.min(F.struct("place", *_OF_LINE)).alias("first")
        leaders = materialize(waiting.groupBy("key").agg(first).select("key", "first.*"), "leaders")
        if turn:
            meeting, own = still, leaders.select("key", "set")
            used = own if used is None else materialize(used.unionByName(own), "used-leaders")
        else:
            # Each line meets the leader of one key, the least, which similar lines tend to share.
            least = F.min(F.struct("key", "place", *_OF_LINE)).alias("least")
            meeting = still.groupBy(F.col("set").alias("_set")).agg(least).select("least.*")
        found = materialize(_verified(_open_pairs(meeting, leaders), held), "settled")
        settled = settled.unionByName(found)
        still = materialize(still.join(sent_if_small(found), "set", "left_anti"), "open-lines")
    return settled.unionByName(_verified(_open_pairs(still, lines), held)).distinct()


def later_matches(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The sets whose first line matches an earlier line of another set.

    ``repeated`` has the first place of every set that several lines have.
    """
    lines = lines_of(docs).filter("set is not null").withColumn("place", _place())
    known = sent_if_small(repeated.select("set", F.col("first").alias("_first")))
    # Of equal lines, only the first goes on.
    lines = lines.join(known, "set", "left").filter("_first is null or place = _first").drop("_first")
    met = materialize(_meetings(keys_of(lines)), "meetings")
    pairs = met.filter("a is not null").select("a", "b")
    large = met.filter("a is null").drop("a", "b")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).unionByName(large.select("set")).distinct()
    wanted = sent_if_small(materialize(wanted, "wanted-sets"))
    held = lines.join(wanted, "set", "left_semi").dropDuplicates(["set"])
    held = materialize(held.select("set", "place", "words", F.expr(f"size(array_distinct({_WORDS}))").alias("n")), "words")
    settled = materialize(_verified(pairs, held), "settled")
    return settled if large.isEmpty() else materialize(_settled_in_large(large, held, settled), "settled")


def mark_lines(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_lines, n_removed and removed (the lines, from 0, in order).

    A line is removed when it matches an earlier one: of a smaller doc_id, or further up in the same
    text, whether or not that line is itself removed. Rows without a doc_id come last. Lines without
    words stay. Where rows share a doc_id, one of two equal lines at the same place stays. A text that
    is null is one empty line. An empty table gives no rows.
    """
    numbered = docs.select("doc_id", "text")
    every = lines_of(numbered.withColumn("row", F.monotonically_increasing_id()), F.col("row"))
    every = materialize(every.drop("words"), "lines")
    repeated = (
        every.filter("set is not null")
        .groupBy("set")
        .agg(F.min(_place("row")).alias("first_row"), F.count("*").alias("lines"))
        .filter("lines > 1")
    )
    first = F.struct("first_row.last", "first_row.doc", "first_row.line").alias("first")
    repeated = materialize(repeated.select("set", "first_row", first), "repeated-sets")
    with _shuffles_freed(docs.sparkSession):
        later = later_matches(numbered, repeated).withColumn("matched", F.lit(True))
    marked = every.join(sent_if_small(repeated.select("set", "first_row")), "set", "left")
    marked = marked.join(sent_if_small(later), "set", "left")
    gone = F.coalesce(F.col("matched"), F.lit(False)) | F.coalesce(_place("row") != F.col("first_row"), F.lit(False))
    marked = marked.select("row", "doc_id", "line", gone.alias("gone"))
    return (
        marked.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.count("*").alias("n_lines"),
            F.count_if("gone").alias("n_removed"),
            F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"),
        )
        .drop("row")
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that match earlier ones, with all columns.

    A text all of whose lines go becomes empty. Rows without a doc_id, or that share one, stay as they
    are, since their lines cannot be told apart.
    """
    marks = mark_lines(docs).filter("doc_id is not null").groupBy("doc_id")
    marks = marks.agg(F.count("*").alias("_rows"), F.first("removed").alias("_removed"))
    key, gone = unused(docs, "_id"), unused(docs, "_removed")
    marks = marks.filter("_rows = 1 and size(_removed) > 0")
    marks = marks.select(F.col("doc_id").alias(key), F.col("_removed").alias(gone))
    joined = docs.join(marks, F.col("doc_id") == F.col(key), "left")
    left = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains(gone, k))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(docs.columns)

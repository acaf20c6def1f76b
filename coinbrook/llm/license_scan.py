"""Licences named in texts: ordered signature rules behind a look for keywords.

Texts become lower-case words, each with a space of its own on either side. Rules are tried only on
texts that hold the keyword of their group. A rule's matches cut the text into pieces, and the words
of pieces and matches, added up, give each match its place. Matches of different rules overlap; one is
suppressed by another that contains it if that one is of a higher level, or of the same level and
longer, or, on the same words, comes earlier in the order of the rules. Containment is transitive, so
one pass over the matches of a text by begin, with the furthest end so far of each level, decides all.

Everything is DataFrame and SQL functions. Only matches are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.llm.common import text_of
from coinbrook.llm.license_rules import CONFIDENCE, LEVELS, RULES, Rule
from coinbrook.sinks.scratch import materialize

#: Fixed value of the task, for texts in which A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def _matches(rules: Sequence[Rule]) -> str:
    """Of the text ``_spread``: number of each rule that matches, words of the pieces between its
    matches and of the matches."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    groups = []
    for keyword in dict.fromkeys(r.keyword for r in rules):
        own = [f"named_struct('no', {r.no}, 'pattern', {quoted(r.pattern)})" for r in rules if r.keyword == keyword]
        groups.append(f"named_struct('keyword', {quoted(keyword)}, 'rules', array({', '.join(own)}))")
    words = "cast((length({0}) - length(replace({0}, ' ', ''))) div 2 as int)"
    return f"""transform(
        filter(
            transform(
                flatten(transform(
                    filter(array({', '.join(groups)}), g -> contains(_spread, g.keyword)), g -> g.rules)),
                r -> named_struct('no', r.no, 'pattern', r.pattern,
                                  'found', regexp_extract_all(_spread, r.pattern, 0))),
            m -> size(m.found) > 0),
        m -> named_struct('no', m.no,
            'sizes', transform(m.found, x -> {words.format('x')}),
            'gaps', transform(split(_spread, m.pattern, -1), x -> {words.format('x')})))"""


def _chosen(rules: Sequence[Rule], value) -> Column:
    """A property of the rule with the number ``no``."""
    return F.element_at(F.lit([value(r) for r in rules]), F.col("no") + 1)


def scan_licenses(docs: DataFrame, carry: list[str] | None = None, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``docs`` with the licences found in it.

    Returns ``row`` (a struct of the columns in ``carry``, by default all), ``n_words`` and ``found``:
    all matches by begin, each with ``begin`` and ``end`` in words (the end exclusive), ``no`` (the
    number of its rule), ``label``, ``level``, ``base`` and ``kept`` (not suppressed). A text that is
    null, empty or without words has none. Rows may repeat; no column is taken for a key.
    """
    own = docs.select(F.struct(*(carry or docs.columns)).alias("row"), words_of(text_of(text)).alias("_words"))
    spread = F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))
    spread = own.select("row", F.size("_words").cast("long").alias("n_words"), spread.alias("_spread"))
    matched = spread.select("row", "n_words", F.expr(_matches(rules)).alias("matches"))
    stored = materialize(matched.withColumn("key", F.monotonically_increasing_id()), "licenses")
    some = F.size("matches") > 0
    places = _judged(_places(stored.filter(some).select("key", "matches"), rules), rules)
    entry = F.struct("begin", "end", "no", "label", "level", "base", "kept")
    found = places.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    nothing = F.array().cast(found.schema["found"].dataType)
    with_matches = stored.filter(some).join(found, "key").select("row", "n_words", "found")
    return with_matches.unionByName(stored.filter(~some).select("row", "n_words", nothing.alias("found")))


def _places(stored: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row for each match: ``key``, ``no``, and its words as ``begin`` and ``end``."""
    each = stored.select("key", F.explode("matches").alias("m"))
    each = each.select("key", "m.no", F.posexplode(F.arrays_zip("m.gaps", "m.sizes")).alias("nth", "at"))
    each = each.select("key", "no", "nth", F.col("at.gaps").alias("gap"), F.col("at.sizes").alias("size"))
    # The piece after the last match has no match of its own.
    each = each.filter(F.col("size").isNotNull())
    before = Window.partitionBy("key", "no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    return each.select("key", "no", (end - F.col("size")).alias("begin"), end.alias("end"))


def _judged(places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The matches with the properties of their rules, and which of them stay."""
    named = places.withColumns(
        {
            "label": _chosen(rules, lambda r: r.label),
            "level": _chosen(rules, lambda r: r.level),
            "base": _chosen(rules, lambda r: r.base),
        }
    )
    order = [F.asc("begin"), F.desc("end"), F.desc("level"), F.asc("no")]
    earlier = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.lit(None).cast("long")
    for level in range(len(LEVELS)):
        furthest = F.max(F.when(F.col("level") >= level, F.col("end"))).over(earlier)
        reached = F.when(F.col("level") == level, furthest).otherwise(reached)
    return named.withColumn("kept", F.coalesce(reached < F.col("end"), F.lit(True)))


def labels(found: str = "found", base: bool = False) -> Column:
    """The distinct labels of the matches that stay and of the base places (of these alone with
    ``base``), sorted and comma-joined."""
    chosen = F.filter(found, lambda m: m["base"] if base else m["base"] | m["kept"])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda m: m["label"]))), ",")


def score(found: str = "found") -> Column:
    """How sure the surest match that stays is; 0 without any."""
    sure = F.lit(list(CONFIDENCE))
    kept = F.transform(F.filter(found, lambda m: m["kept"]), lambda m: F.get(sure, m["level"]))
    return F.coalesce(F.array_max(kept), F.lit(0.0))


def base_places(found: str = "found") -> Column:
    """First words of the base places, in order."""
    return F.transform(F.filter(found, lambda m: m["base"]), lambda m: m["begin"])

"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Documents are counted into cells of source, language and topic, combined before the shuffle. The
token weights of the cells are raked: scaled so that the sums by source meet their targets, then
those by language, then those by topic, and again until nothing changes. A document is sampled with a
probability in proportion to the weight that a token of its cell has got.

Only cells travel, one row for each combination, so a source with a third of all rows is no more
than its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from coinbrook.llm.common import text_of
from coinbrook.sinks.scratch import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: the share of a value is its share of the tokens to this power, brought to sum one.
#: Less than one evens out the sources and languages; topics stay as they are.
TEMPERATURES = {"source": 0.5, "lang": 0.5, "topic": 1.0}
#: Expected share of all tokens in the sample.
TOKEN_SHARE = 0.7
TOLERANCE = 1e-9
MAX_ROUNDS = 60
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.size(F.filter(F.split(text, _SPACES), lambda w: w != "")).cast("long")


def form_of(text: Column, words: Column) -> Column:
    """The topic of a text where no column tells it: its form.

    'symbols' if over a tenth of the characters are neither letters, digits, white space nor usual
    punctuation, 'listing' if its lines have under eight words on average, 'note' under 100 words,
    else 'prose'.
    """
    odd = F.length(text) - F.length(F.translate(text, "#$%&*+<=>@\\^_`{|}~/[]", ""))
    lines = F.size(F.split(text, "\n"))
    return (
        F.when(odd * 10 > F.length(text), "symbols")
        .when(words < lines * 8, "listing")
        .when(words < 100, "note")
        .otherwise("prose")
    )


def _same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def _counted(docs: DataFrame, topic: Column | None) -> DataFrame:
    """``row``, the dimensions and the number of tokens of every row."""
    words = n_words(text_of())
    own = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        words.alias("n_tokens"),
        text_of().alias("_text"),
        *([topic.cast("string").alias("topic")] if topic is not None else []),
    )
    if topic is None:
        own = own.withColumn("topic", form_of(F.col("_text"), F.col("n_tokens")))
    return own.drop("_text")


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``value``, ``share``: each value's tokens to the power, as a share of all."""
    raised = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raised"))
    total = raised.agg(F.sum("raised").alias("all"))
    return raised.crossJoin(F.broadcast(total)).select("value", (F.col("raised") / F.col("all")).alias("share"))


def _present(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """All targets as ``dimension``, ``value``, ``share``, without the values that no cell has, and
    with sum one in each dimension."""
    held = None
    for dimension, target in targets.items():
        values = cells.filter("tokens > 0").select(F.col(dimension).alias("_value")).distinct()
        own = target.join(values, target["value"].eqNullSafe(values["_value"]), "left_semi")
        own = own.select(F.lit(dimension).alias("dimension"), "value", "share")
        held = own if held is None else held.unionByName(own)
    sums = held.groupBy(F.col("dimension").alias("_dimension")).agg(F.sum("share").alias("all"))
    shared = held.join(sums, F.col("dimension") == F.col("_dimension"))
    return materialize(shared.select("dimension", "value", (F.col("share") / F.col("all")).alias("share")), "targets")


def _scale(cells: DataFrame, dimension: str, targets: DataFrame, total: float) -> DataFrame:
    """Scale the weights so that the sums by ``dimension`` are the target shares of the total.

    Values without a target get weight zero.
    """
    sums = cells.groupBy(F.col(dimension).alias("_value")).agg(F.sum("weight").alias("sum"))
    sums = sums.filter("sum > 0")
    own = targets.filter(F.col("dimension") == dimension)
    factors = sums.join(own, F.col("_value").eqNullSafe(F.col("value")))
    factors = factors.select("_value", (F.col("share") * F.lit(total) / F.col("sum")).alias("factor"))
    scaled = cells.join(factors, cells[dimension].eqNullSafe(factors["_value"]), "left")
    return scaled.withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("_value", "factor")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` (dimensions, ``tokens``) with ``weight``, whose sums by each dimension meet the targets.

    Targets (``value``, ``share``) of values that no cell has are left out, and the others brought to
    sum one. Where empty cells make the targets unreachable together, the weights of the last round
    are returned: then the topics' targets are met, the others as nearly as raking gets.
    """
    present = _present(cells, targets)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        after = now.withColumn("before", F.col("weight"))
        for dimension in targets:
            after = _scale(after, dimension, present, total)
        # The change is observed while the round is written.
        moved = F.abs(F.col("weight") - F.col("before")) / F.greatest("before", F.lit(1e-300))
        seen = Observation()
        now = materialize(after.observe(seen, F.max(moved).alias("change")), "cells").drop("before")
        change = seen.get.get("change")
        if change is None or change <= tolerance:
            break
    return now


def inclusion(cells: DataFrame, token_share: float) -> DataFrame:
    """``cells`` with ``probability``: min(1, k * weight / tokens), k such that the expected tokens are
    ``token_share`` of all.

    k starts where it would be if no probability were cut off at one, and is raised to make up for
    those that are, until no further one is. Each step is one aggregate over the cells.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rated = cells.withColumn("ratio", ratio)
    tokens, weight = rated.agg(F.sum("tokens"), F.sum("weight")).first()
    if not weight:
        return rated.withColumn("probability", F.lit(0.0)).drop("ratio")
    wanted = token_share * float(tokens)
    k = wanted / weight
    while True:
        sure = F.lit(k) * F.col("ratio") >= 1
        full, rest = rated.agg(F.sum(F.when(sure, F.col("tokens"))), F.sum(F.when(~sure, F.col("weight")))).first()
        raised = max(0.0, wanted - (full or 0)) / rest if rest else k
        if raised <= k * (1 + 1e-12):
            break
        k = raised
    return rated.withColumn("probability", F.least(F.lit(1.0), F.lit(k) * F.col("ratio"))).drop("ratio")


def draw(seed: int) -> Column:
    """A number from 0 to below 1 by doc_id and text, so that a repeated run draws the same sample."""
    drawn = F.xxhash64(F.col("row.doc_id"), F.col("row.text"), F.lit(seed))
    return F.shiftrightunsigned(drawn, 11) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    token_share: float = TOKEN_SHARE,
    seed: int = 17,
) -> DataFrame:
    """Every row with its cell and its part in the sample.

    ``targets`` holds ``value``, ``share`` for any of source, lang and topic; a dimension without
    targets gets tempered shares of what is there. ``topic`` tells the topic of a row, by default the
    form of its text. Returns ``row`` (all columns), ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``weight`` (of one token of the cell), ``probability`` and ``sampled``. Null is a value of its own
    in each dimension; a text that is null or has no words has no tokens, and cells without any have
    probability 0. Rows that repeat doc_id and text are drawn together. An empty table gives no rows.
    """
    counted = _counted(docs, topic)
    cells = materialize(counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "counted")
    wanted = {
        d: (targets or {}).get(d) or tempered_targets(cells, d, TEMPERATURES[d]) for d in DIMENSIONS
    }
    rated = inclusion(rake(cells, wanted), token_share)
    weight = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rated = materialize(rated.select(*DIMENSIONS, weight.alias("weight"), "probability"), "rated")
    joined = counted.join(rated, _same(counted, rated, DIMENSIONS), "left")
    return joined.select(
        "row",
        *[counted[d] for d in DIMENSIONS],
        "n_tokens",
        "weight",
        "probability",
        (draw(seed) < F.col("probability")).alias("sampled"),
    )


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows, with all columns of ``docs`` and the probability of each as ``mix_probability``,
    in place of a column of that name."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "mix_probability"]
    return mix(docs, **options).filter("sampled").select(*own, F.col("probability").alias("mix_probability"))

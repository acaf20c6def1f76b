"""Secrets in texts: known forms by pattern, and other random strings by a battery of tests.

Everything is DataFrame and SQL functions over one row at a time; only a small histogram is
aggregated.

*Known forms* are the leftmost non-overlapping matches of three patterns, those too short dropped.

*Random strings.* Candidates are all runs of at least 20 characters of the base64 alphabets. The
encoding is inferred from the characters (decimal, hexadecimal, letters of one case, base32, base36,
letters of both cases, base62, base64), and the characters become numbers in its alphabet. Under the hypothesis that the string is
random, these have known distributions:

* chi-squared of the character counts against the uniform alphabet (mean k - 1, variance
  2 (k - 1) (n - 1) / n),
* number of runs above and below the middle of the alphabet,
* correlation of each number with the next one.

The three p-values are combined by Fisher's method. A candidate is dismissed as ordinary text when
the hypothesis is rejected. Long strings give sharper tests than short ones, so the rejections are
controlled by the Benjamini-Hochberg rule within each class of length: at most the share
``FALSE_DISMISSALS`` of the dismissed strings is expected to have been random. What is not dismissed
is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import text_of

#: Known forms, in the order in which they are listed: kind, pattern, group that must be long enough,
#: least length. Fixed values of the task.
FORMS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of under 32 characters are dropped in any case, so they need not be found.
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_DISMISSALS = 0.01

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Encodings by the characters that they allow, the first that fits being taken.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS),
    ("^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("^([a-z]+|[A-Z]+)$", _LOWER),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Bins of minus log10 p, each a hundredth wide; smaller p-values share the last one.
BINS = 3000


def spans_of(text: Column, pattern: str, group: int, least: int) -> Column:
    """The matches of a pattern: struct of begin, end (code points) and the matched text.

    The text between matches and the matches add up to the whole, which gives the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), found.alias("match"), judged.alias("judged")
    )
    kind = "array<struct<s:int,e:int,t:string,n:int>>"
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))).alias("at"),
            F.when(
                F.length(p["judged"]) >= least,
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(p["gap"])).alias("s"),
                            (a["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("e"),
                            p["match"].alias("t"),
                            F.length(p["judged"]).alias("n"),
                        )
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(kind))


def upper_tail(z: str) -> str:
    """Probability that a standard normal number exceeds z (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    series = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    tail = f"(exp(-0.5 * {z} * {z}) / 2.5066282746310002 * {series})"
    return f"if({z} >= 0, {tail}, 1 - {tail})"


def _tested(found: str) -> str:
    """SQL: the candidates with length ``n`` and the combined p-value ``p`` of the battery.

    Each ``transform`` adds what the next one uses, as a lambda has no names for values in between.
    """
    alphabet = "CASE"
    for allowed, letters in ENCODINGS[:-1]:
        alphabet += f" WHEN x.body RLIKE '{allowed}' THEN '{letters}'"
    alphabet += f" ELSE '{ENCODINGS[-1][1]}' END"
    one_case = "if(x.alphabet = upper(x.alphabet) OR x.alphabet RLIKE '[A-Z]', x.body, lower(x.body))"
    steps = (
        "named_struct('s', x.s, 'e', x.e, 'body', translate(rtrim('=', x.t), '-_', '+/'))",
        f"named_struct('s', x.s, 'e', x.e, 'body', x.body, 'alphabet', {alphabet})",
        f"""named_struct('s', x.s, 'e', x.e, 'k', length(x.alphabet), 'body', {one_case},
            'v', transform(split({one_case}, ''), c -> instr(x.alphabet, c) - 1))""",
        """named_struct('s', x.s, 'e', x.e, 'k', x.k, 'v', x.v, 'n', size(x.v),
            'squares', aggregate(array_distinct(split(x.body, '')), 0D,
                (a, c) -> a + pow(length(x.body) - length(replace(x.body, c, '')), 2)),
            'high', aggregate(x.v, 0, (a, i) -> a + if(2 * i >= x.k, 1, 0)),
            'mean', aggregate(x.v, 0D, (a, i) -> a + i) / size(x.v))""",
        """named_struct('s', x.s, 'e', x.e, 'n', x.n, 'k', x.k, 'high', x.high,
            'chi', x.k * x.squares / x.n - x.n,
            'runs', 1 + aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1),
                (i, j) -> if((2 * i >= x.k) != (2 * j >= x.k), 1, 0)), 0, (a, b) -> a + b),
            'around', aggregate(x.v, 0D, (a, i) -> a + (i - x.mean) * (i - x.mean)),
            'next', aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1),
                (i, j) -> (i - x.mean) * (j - x.mean)), 0D, (a, b) -> a + b))""",
        """named_struct('s', x.s, 'e', x.e, 'n', x.n,
            'z1', (x.chi - (x.k - 1)) / sqrt(2D * (x.k - 1) * (x.n - 1) / x.n),
            'expected', 2D * x.high * (x.n - x.high) / x.n + 1, 'runs', x.runs,
            'z3', if(x.around > 0, abs(x.next / x.around * sqrt(x.n) + 1 / sqrt(x.n)), 40D))""",
        """named_struct('s', x.s, 'e', x.e, 'n', x.n, 'z1', x.z1, 'z3', x.z3,
            'z2', if(x.expected > 2, abs(x.runs - x.expected) /
                sqrt((x.expected - 1) * (x.expected - 2) / (x.n - 1)), 40D))""",
        f"""named_struct('s', x.s, 'e', x.e, 'n', x.n, 'h',
            - ln(greatest({upper_tail("x.z1")}, 1e-300D))
            - ln(greatest(least(1D, 2 * {upper_tail("x.z2")}), 1e-300D))
            - ln(greatest(least(1D, 2 * {upper_tail("x.z3")}), 1e-300D)))""",
        "named_struct('s', x.s, 'e', x.e, 'n', x.n, 'p', exp(-x.h) * (1 + x.h + x.h * x.h / 2))",
    )
    sql = found
    for step in steps:
        sql = f"transform({sql}, x -> {step})"
    return sql


def _length_class(n: Column) -> Column:
    """0 from 20 characters, 1 from 32, 2 from 64, and so on."""
    return F.greatest(F.lit(0), F.floor(F.log2(n)) - 4).cast("int")


def dismissal_bounds(tested: DataFrame, false_dismissals: float) -> dict[int, float]:
    """For each class of length, the largest p-value that is dismissed (Benjamini-Hochberg).

    P-values are counted in bins, each taken at its upper end, so the rule is kept and what is
    gathered does not grow with the number of candidates.
    """
    each = tested.select(F.explode("candidates").alias("c"))
    place = F.floor(-F.log10(F.greatest(F.col("c.p"), F.lit(1e-300))) * 100)
    bins = each.groupBy(
        _length_class(F.col("c.n")).alias("class"), F.least(place, F.lit(BINS)).cast("int").alias("bin")
    ).count()
    bounds: dict[int, float] = {}
    totals: dict[int, int] = {}
    rows = sorted(bins.collect(), key=lambda r: (r["class"], -r["bin"]))  # at most BINS for a class
    sizes: dict[int, int] = {}
    for r in rows:
        sizes[r["class"]] = sizes.get(r["class"], 0) + r["count"]
    for r in rows:
        totals[r["class"]] = totals.get(r["class"], 0) + r["count"]
        upper = 10 ** (-r["bin"] / 100)
        if upper <= false_dismissals * totals[r["class"]] / sizes[r["class"]]:
            bounds[r["class"]] = upper
    return bounds


def scan_secrets(docs: DataFrame, false_dismissals: float = FALSE_DISMISSALS) -> DataFrame:
    """Every row with the arrays of spans ``assign``, ``access``, ``hex`` and ``random``.

    Returns ``row`` (a struct of all columns) and the arrays, each a struct with ``s`` and ``e`` in
    code points, the end exclusive. A text that is null or empty has none. Random strings inside a
    span of a known form are left to it. Without candidates nothing is dismissed or found.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("_text"))
    tested = own.select(spans_of(F.col("_text"), CANDIDATE, 0, 20).alias("found"))
    tested = tested.filter(F.size("found") > 0).select(F.expr(_tested("found")).alias("candidates"))
    bounds = dismissal_bounds(tested, false_dismissals)
    base = own.select("row", "_text", *[spans_of(F.col("_text"), p, g, n).alias(kind) for kind, p, g, n in FORMS])
    found = base.withColumn("found", spans_of(F.col("_text"), CANDIDATE, 0, 20)).drop("_text")
    judged = found.withColumn("candidates", F.expr(_tested("found")))

    def stays(c: Column) -> Column:
        bound = F.lit(0.0)
        for k, value in bounds.items():
            bound = F.when(_length_class(c["n"]) == k, F.lit(value)).otherwise(bound)
        known = F.concat("assign", "access", "hex")
        inside = F.exists(known, lambda b: (b["s"] <= c["s"]) & (b["e"] >= c["e"]))
        return (c["p"] > bound) & ~inside

    return judged.select("row", *[kind for kind, *_ in FORMS], F.filter("candidates", stays).alias("random"))


def joined_spans(kinds: list[str]) -> Column:
    """``kind:begin:end`` of the spans by begin, then in the order of the kinds, comma-joined."""
    def placed(place: int, kind: str) -> Column:
        def text(x: Column) -> Column:
            return F.concat_ws(":", F.lit(kind), x["s"], x["e"])

        return F.transform(
            kind, lambda x: F.struct(x["s"].alias("s"), F.lit(place).alias("k"), text(x).alias("text"))
        )

    parts = [placed(place, kind) for place, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["text"]), ",")

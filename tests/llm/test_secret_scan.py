import random
import re
import string

from pyspark.sql import functions as F

from coinbrook.llm import secret_scan

PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def brute(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def base(frame):
    found = secret_scan.scan_secrets(frame)
    spans = secret_scan.joined_spans(["assign", "access", "hex"])
    return {r.id: r.spans for r in found.select(F.col("row.doc_id").alias("id"), spans.alias("spans")).collect()}


def test_known_forms_against_python(docs, texts):
    draw = random.Random(7)
    pieces = ["token=", "SECRET : ", "api_key='", 'password": "', "AKIA", "0123456789abcdef", "é😀", " ", "=", ":", "x1Y2", "\n", "ABCDEFGH12345678"]
    rows = [(k, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 40)))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "token=token:abcdefgh"), (1003, "a" * 90_000 + " token=abcdefgh1"), (1004, "tokens=abcdefgh")]
    rows += [(2000 + d, t) for d, t, _ in texts]
    got = base(docs(rows))
    assert got == {d: brute(t) for d, t in rows}
    assert sum(bool(x) for x in got.values()) > 30


def test_random_strings_are_found_and_words_are_not(docs):
    draw = random.Random(11)
    alphabet = string.ascii_letters + string.digits
    secret = ["".join(draw.choice(alphabet) for _ in range(n)) for n in (40, 48, 64, 80)]
    plain = ["internationalisation2024aaaaaaaaaaaaaaaaaaaaaaaa", "the-quick-brown-fox-jumps-over-the-lazy-dog-12345", "aaaaaaaaaaaaaaaaaaaa1111111111111111111"]
    rows = [(k, f"see {s} here") for k, s in enumerate(secret)]
    rows += [(100 + k, f"see {s} here") for k, s in enumerate(plain * 20)]
    found = secret_scan.scan_secrets(docs(rows)).select("row.doc_id", F.size("random").alias("n"), "random").collect()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].n == 1 for k in range(len(secret)))
    assert (by_id[0].random[0].s, by_id[0].random[0].e) == (4, 44)
    assert not any(by_id[100 + k].n for k in range(len(plain) * 20))


def test_random_letters_are_found(docs):
    """Keys without a digit are tested, too; words and repeated letters are dismissed by the battery."""
    draw = random.Random(5)
    alphabets = (string.ascii_uppercase, string.ascii_lowercase, string.ascii_letters)
    keys = ["".join(draw.choice(a) for _ in range(n)) for a in alphabets for n in (40, 64)]
    plain = ["the-quick-brown-fox-jumps-over-the-lazy-dog-again", "a" * 40, "donaudampfschifffahrtsgesellschaftskapitaen" * 2]
    rows = [(k, f"see {s} here") for k, s in enumerate(keys)]
    rows += [(100 + k, f"see {s} here") for k, s in enumerate(plain * 20)]
    found = {r.doc_id: r.random for r in secret_scan.scan_secrets(docs(rows)).select("row.doc_id", "random").collect()}
    assert [[(x.s, x.e) for x in found[k]] for k in range(len(keys))] == [[(4, 4 + len(s))] for s in keys]
    assert not any(found[100 + k] for k in range(len(plain) * 20))


def test_strings_inside_known_forms_are_left_to_them(docs):
    found = secret_scan.scan_secrets(docs([(1, "token=q8ZtR2mW0xK5vB7nL4sD9fG1hJ3cP6yT")])).collect()[0]
    assert len(found.assign) == 1 and found.random == []


def test_normal_tail(spark):
    import math

    z = [-6.0, -1.5, 0.0, 0.3, 2.0, 5.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select(F.expr(secret_scan.upper_tail("z"))).collect()
    assert all(abs(r[0] - 0.5 * math.erfc(x / math.sqrt(2))) < 1e-6 for r, x in zip(rows, z, strict=True))


def test_no_rows(docs):
    assert secret_scan.scan_secrets(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = secret_scan.scan_secrets(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

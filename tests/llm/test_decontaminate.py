import collections
import re

import pytest

from coinbrook.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        own = words(text)
        width = min(size, len(own))
        for i in range(len(own) - width + 1) if own and item is not None else ():
            windows[tuple(own[i : i + width])].add(str(item))
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(own) - width + 1):
                if tuple(own[i : i + width]) in windows:
                    hit.update(range(i, i + width))
                    found |= windows[tuple(own[i : i + width])]
        out.append((doc_id, len(own), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=repr)


def got(frame, items, spark, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(frame, benchmark, **options).collect()
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in rows), key=repr)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short, item!"),
    (3, None),
    (4, " ... "),
    (5, "two three four five six seven eight nine ten eleven"),
    (10, "a a a a a a a a a a a"),
    (None, "never used here"),
]
ROWS = [
    (1, "x one two three four five six seven eight nine ten y"),
    (2, "ONE two-three four five six seven eight nine ten, eleven twelve. short item"),
    (3, None),
    (4, ""),
    (5, "a " * 30),
    (6, "shorté item"),
    (7, "two three four five six seven eight nine"),
    (8, "item short item"),
    (8, "item short item"),
    (None, "short item"),
    (9, "never used here " * 2000 + "short item"),
]


@pytest.mark.parametrize("block", [200_000, 2])
def test_windows_in_one_or_several_blocks(spark, docs, block):
    assert got(docs(ROWS), ITEMS, spark, block_windows=block) == brute(ROWS, ITEMS)


def test_test_documents_against_their_benchmark(spark, docs, texts, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t, _ in texts]
    want = brute(rows, items)
    assert got(docs(rows), items, spark) == want
    assert any(w[2] for w in want)


def test_empty_tables(spark, docs):
    assert got(docs([]), ITEMS, spark) == []
    assert got(docs(ROWS), [], spark) == brute(ROWS, [])


def test_only_clean_rows_stay_with_their_columns(spark, docs):
    frame = docs(ROWS).withColumnRenamed("n_chars", "row")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]

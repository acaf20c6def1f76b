import random

from coinbrook.llm import exact_dedup


def brute(rows):
    keep = {}
    for doc_id, text in rows:
        own = keep.setdefault(text or "", [None, 0])
        own[1] += 1
        if doc_id is not None and (own[0] is None or doc_id > own[0]):
            own[0] = doc_id
    return sorted(((d, *keep[t or ""]) for d, t in rows), key=repr)


def marked(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.mark_copies(frame).collect()), key=repr)


def test_copies_nulls_and_ties(docs):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (None, "b"), (3, "a"), (None, "q")]
    rows += [(100 + k, "hot") for k in range(50)]
    assert marked(docs(rows)) == brute(rows)
    kept = {r.doc_id: r.kept for r in exact_dedup.mark_copies(docs(rows)).filter("doc_id < 10").collect()}
    assert kept == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True}


def test_one_row_of_each_text_stays_with_all_columns(docs):
    rows = [(1, "a"), (3, "a"), (3, "a"), (2, None), (5, ""), (None, "z"), (None, "z")]
    frame = docs(rows).withColumnRenamed("n_chars", "group_size")
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(3, "a"), (5, ""), (None, "z")]


def test_empty_table(docs):
    assert exact_dedup.mark_copies(docs([])).count() == 0
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_spilled_buckets_give_the_same_groups(docs):
    draw = random.Random(4)
    rows = [(k, draw.choice("xyz") * draw.randint(1, 400)) for k in range(600)]
    groups = exact_dedup.content_groups(docs(rows).coalesce(1), ["text"], table_chars=300).collect()
    want = {}
    for doc_id, text in rows:
        keep, size = want.get(text, (-1, 0))
        want[text] = (max(keep, doc_id), size + 1)
    assert {r.payload.text: (r.keep_id, r.group_size) for r in groups} == want
    assert len(groups) == len(want)


def test_equal_hashes_are_told_apart_by_content():
    table = exact_dedup.ContentTable(2)
    rows = [[7, "a", 1, 1, None], [7, "b", 2, 1, None], [7, "a", 3, 1, None]]
    for row in rows:
        if not table.merge(row):
            table.add(row)
    assert [(r[1], r[2], r[3]) for r in table.rows] == [("a", 3, 2), ("b", 2, 1)]


def test_spill_files_of_rows_with_one_hash(tmp_path):
    rows = [[5, str(k), k, 1, {"x": k}] for k in range(40)]
    import pyarrow as pa

    kinds = [("h", pa.int64()), ("t", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("p", pa.struct([("x", pa.int64())]))]
    found = list(exact_dedup._groups(iter(rows), 3, str(tmp_path), pa.schema(kinds)))
    assert sorted(r[1] for r in found) == sorted(str(k) for k in range(40))
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]

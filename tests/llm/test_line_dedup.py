import collections
import random
import re

import pytest

from coinbrook.llm import line_dedup


def brute(rows):
    """Lines that match an earlier one, by comparing sets of words."""
    lines = [(d, i, frozenset(w for w in re.split("[ \t\x0b\f\r]+", line) if w)) for d, t in rows for i, line in enumerate((t or "").lower().split("\n"))]
    lines.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    inside, known, out = collections.defaultdict(list), [], collections.defaultdict(list)
    for d, i, own in lines:
        shared = collections.Counter(k for w in own for k in inside[w])
        if any(5 * n >= 4 * (len(own) + len(known[k]) - n) for k, n in shared.items()):
            out[d].append(i)
        for w in own:
            inside[w].append(len(known))
        known.append(own)
    return {d: sorted(out.get(d, [])) for d, _ in rows}


def got(frame):
    return {r.doc_id: r.removed for r in line_dedup.mark_lines(frame).collect()}


def variants(seed, copies):
    draw = random.Random(seed)
    rows = []
    for k in range(copies):
        lines = []
        for base in range(4):
            words = [f"w{base}_{j}" for j in range(5 + 7 * base)]
            for _ in range(draw.randint(0, 2 + base)):
                words[draw.randrange(len(words))] = f"x{draw.randint(0, 30)}"
            lines.append(" ".join(words))
        draw.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    return rows


def test_test_documents(docs, texts):
    rows = [(d, t) for d, t, _ in texts]
    assert got(docs(rows)) == brute(rows)


@pytest.mark.parametrize(("rare", "group"), [(128, 128), (8, 4)])
def test_many_variants_of_a_line(docs, monkeypatch, rare, group):
    """With small bounds, the keys are pairs of words and hold more lines than are compared at once."""
    monkeypatch.setattr(line_dedup, "RARE", rare)
    monkeypatch.setattr(line_dedup, "GROUP", group)
    rows = variants(5, 60)
    assert got(docs(rows)) == brute(rows)


@pytest.mark.parametrize("group", [128, 4])
def test_wide_lines_lose_no_match(docs, monkeypatch, group):
    """Parities of 128 places apply where both lines are wide; here some are and some are not."""
    monkeypatch.setattr(line_dedup, "WIDE", 12)
    monkeypatch.setattr(line_dedup, "GROUP", group)
    rows = variants(8, 60)
    assert got(docs(rows)) == brute(rows)


def test_wide_lines_that_share_few_words_are_no_candidates(docs):
    shared = " ".join(f"s{j}" for j in range(40))
    rows = [(k, shared + "".join(f" u{k}_{j}" for j in range(110))) for k in range(40)]
    lines = line_dedup.lines_of(docs(rows))
    met = line_dedup._meetings(line_dedup.keys_of(lines, [0] * (line_dedup.PLACES // 16)))
    assert met.count() <= 8, "of 780 pairs; 64 places let hundreds through"


def test_keys_grow_in_proportion_to_the_words(docs):
    """Pairs of the words of a prefix, the keys before, would be 861 a line here."""
    words = [f"word{k}" for k in range(400)]
    draw = random.Random(4)
    rows = [(k, " ".join(draw.sample(words, 200))) for k in range(150)]
    assert line_dedup.keys_of(line_dedup.lines_of(docs(rows))).count() <= 150 * 100


@pytest.mark.parametrize("rare", [0, 9, 128])
def test_matches_of_other_sizes(docs, monkeypatch, rare):
    """Sets on both sides of the sizes where the number of parts changes, and of 4 to 6 words."""
    monkeypatch.setattr(line_dedup, "RARE", rare)
    draw, rows = random.Random(6), []
    for base, n in enumerate([4, 5, 9, 11, 12, 14, 21, 23, 24, 28, 46, 47, 48, 55]):
        words = [f"{'long' * (j % 3)}{base}{chr(97 + j % 26)}{j}" for j in range(n)]
        for _ in range(12):
            gone = set(draw.sample(words, draw.randint(0, n // 5 + 1)))
            more = [f"m{draw.randint(0, 99)}" for _ in range(draw.choice([0, 0, n // 9, n // 4]))]
            line = [w for w in words if w not in gone] + more
            draw.shuffle(line)
            rows.append((len(rows), " ".join(line)))
    found = got(docs(rows))
    assert found == brute(rows)
    assert sum(map(len, found.values())) > 40


def test_nulls_short_lines_and_ties(docs):
    rows = [(1, None), (2, ""), (3, "a b\nb a\nA  B\t\r\n\n\nc"), (4, "c\nb b a"), (None, "c\nnew line of words"), (5, "a b c d e\na b c d\na b c"), (6, "new line of words")]
    assert got(docs(rows)) == brute(rows)


def test_repeated_rows_keep_one_line(docs):
    found = sorted(tuple(r.removed) for r in line_dedup.mark_lines(docs([(1, "same text"), (1, "same text")])).collect())
    assert found == [(), (0,)]


def test_texts_without_the_removed_lines(docs):
    frame = docs([(1, "a\nb\na"), (2, "b\nq"), (3, None), (None, "b"), (4, "q")]).withColumnRenamed("n_chars", "removed")
    cleaned = line_dedup.drop_repeated_lines(frame)
    assert cleaned.columns == frame.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {1: "a\nb", 2: "q", 3: None, None: "b", 4: ""}


def test_empty_table(docs):
    assert got(docs([])) == {}


def test_no_python_in_the_plan(docs):
    plan = line_dedup.mark_lines(docs([(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

"""Licences against SQL, and against a scan that compares all matches in Python."""

import re

import pytest

from coinbrook.llm import license_scan as ls
from coinbrook.llm.license_rules import BASE, CONFIDENCE, LEVELS, RULES, spread
from coinbrook.llm.queries import op12_licenses


def plain(text):
    """(begin, end, rule, kept) of all matches, and the number of words."""
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(ls.WORD, lower)
    line = " " + "  ".join(words) + " "
    found = []
    for rule in RULES:
        if rule.keyword not in line:
            continue
        for m in re.finditer(rule.pattern, line):
            begin = len(line[: m.start()].split())
            found.append((begin, begin + len(m.group().split()), rule))

    def wins(o, p):
        longer = (o[1] - o[0]) > (p[1] - p[0])
        stronger = o[2].level > p[2].level
        same = o[2].level == p[2].level
        return o is not p and o[0] <= p[0] and o[1] >= p[1] and (
            stronger or same and (longer or (o[:2] == p[:2] and o[2].no < p[2].no))
        )

    kept = [(b, e, rule.no, not any(wins(o, (b, e, rule)) for o in found if o[2].no != rule.no)) for b, e, rule in found]
    return sorted(kept), len(words)


TEXTS = [
    None,
    "",
    " .,- ",
    "Released under the MIT License.",
    "MIT\nLICENSE mit-license MIT Licensed mit license mit license",
    "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "GNU Lesser General Public License v2.1, or the GNU General Public License version 3 or any later version",
    "SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
    "https://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.",
    "BSD 3-Clause License. Neither the name of the copyright holder nor the names of its contributors may be "
    "used to endorse or promote products derived from this software",
    "smith license, mitlicense, permit license: none of them",
    "Öffentlich unter der MIT License, Ñ café",
    "general public license " * 300 + "the gnu general public license version 2 " * 200,
]


@pytest.fixture(scope="module")
def scanned(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    rows = ls.scan_licenses(frame, carry=["doc_id"]).collect()
    return {r["row"]["doc_id"]: r for r in rows}


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_equals_plain_scan(scanned, k):
    found, n_words = plain(TEXTS[k])
    assert scanned[k]["n_words"] == n_words
    assert sorted((f["begin"], f["end"], f["no"], f["kept"]) for f in scanned[k]["found"]) == found


def kept_labels(row):
    return sorted({f["label"] for f in row["found"] if f["kept"]})


def test_labels(scanned):
    assert kept_labels(scanned[3]) == ["mit"]
    assert kept_labels(scanned[5]) == ["apache-2.0"]
    assert kept_labels(scanned[6]) == ["gpl-3.0-or-later", "lgpl-2.1"]
    assert kept_labels(scanned[7]) == ["gpl-2.0-or-later", "gpl-2.0-with-classpath-exception"]
    assert kept_labels(scanned[8]) == ["apache-2.0", "cc-by-nc-sa-4.0"]
    assert kept_labels(scanned[9]) == ["cc-by-4.0", "cc-by-nc-4.0"]
    assert kept_labels(scanned[10]) == ["bsd-3-clause"]
    assert kept_labels(scanned[11]) == []


def test_rules_are_sound():
    assert len(RULES) > 300 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    for rule in RULES:
        assert not re.search(r" [?*+{]", rule.pattern), rule
        assert re.search(rf"\b{rule.keyword.strip()}\b", rule.pattern), rule
    assert [(r.label, r.pattern) for r in RULES if r.base] == [(k, spread(p)) for k, p in BASE.items()]
    assert len(LEVELS) == len(CONFIDENCE)


def test_digest_repeats_and_clashing_names(spark, tmp_path):
    text = "A general public license, an MIT license and the mit license"
    rows = [(7, text, 1, "x", 2, 3), (7, text, 1, "x", 2, 3), (None, None, None, None, None, None)]
    names = "doc_id int, text string, key int, found string, no int, row int"
    frame = spark.createDataFrame(rows, names)
    whole = sorted((tuple(r["row"]) for r in ls.scan_licenses(frame).collect()), key=repr)
    assert whole == sorted(rows, key=repr)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_licenses(spark, str(tmp_path)).collect()), key=repr)
    one = (7, 11, 3, 1, 9, "gpl,mit", "gpl,mit", 0.5)
    assert got == [one, one, (None, 0, 0, None, None, "", "", 0.0)]


def test_empty_table_and_no_python(spark):
    frame = spark.createDataFrame([], "doc_id int, text string")
    found = ls.scan_licenses(frame)
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

"""Extra columns with the names that the operators use themselves change no result and stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coinbrook.llm import line_dedup

NAMES = (
    "_text _dropped __dropped _id _removed _rows _stays _key _repeated _hash _size _payload row key label payload "
    "lang_pred score held_out text_sha256 keep_id group_size kept component_id stays weight probability sampled "
    "n_tokens topic cell n_words n_hit items removed n_lines mix_probability"
).split()


@pytest.fixture(scope="module")
def both(spark, sf):
    """A part of the documents, alone and with all these columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40")
    # Both come from files, so that nothing is told by the way the table was made.
    extra = docs.withColumns({name: F.concat(F.lit(f"{name} "), F.col("doc_id")) for name in NAMES})
    return docs, extra


#: Each stage of the pipeline is one of the keep, drop and sample functions.
STEPS = dict(corpus_pipeline.STAGES) | {"lines": lambda spark, docs, sf: line_dedup.drop_repeated_lines(docs)}


@pytest.mark.parametrize("name", list(STEPS))
def test_clashing_columns(spark, sf, both, name):
    docs, extra = both
    plain, wide = STEPS[name](spark, docs, sf), STEPS[name](spark, extra, sf)
    assert set(wide.columns) == set(plain.columns) | set(NAMES) and len(wide.columns) == len(set(wide.columns))
    got = wide.select(*plain.columns, *NAMES).collect()
    want = sorted(map(tuple, plain.collect()))
    assert sorted(tuple(r)[: len(plain.columns)] for r in got) == want != []
    replaced = set(plain.columns) - set(docs.columns)
    assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in NAMES if n not in replaced)

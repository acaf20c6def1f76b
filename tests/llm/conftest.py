import os

import pytest

from coinbrook.llm.common import ready

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    return ready(spark)


@pytest.fixture
def docs(spark):
    """Documents with every column, from (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", f"src{k % 3}", 0) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id and text of the small test documents."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    return [(r.doc_id, r.text, r.lang) for r in rows]

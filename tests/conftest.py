import os
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

from coinbrook.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="coinbrook-tests-")
    session = local_session(
        4,
        "tests",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.default.parallelism": "2",
            "spark.sql.warehouse.dir": f"{work}/warehouse",
            "spark.checkpoint.dir": f"{work}/shared",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def without_compilation(spark):
    """For tests on a few rows, where compiling each plan would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from tapeframe import build_session  # noqa: E402
from tapeframe.operators import scan  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[8]", "tapeframe-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
           # Tiny inputs: compiling stages would take most of the time. tools/check.py runs compiled.
           "spark.sql.codegen.wholeStage": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def chunked(spark):
    """Force the hot-key plans with a few rows per chunk."""
    spark.conf.set(scan.CHUNK_ROWS_CONF, "7")
    yield 7
    spark.conf.unset(scan.CHUNK_ROWS_CONF)


@pytest.fixture(params=["plain", "chunked"])
def both_plans(request, spark):
    """Run a test under the plain and the hot-key plans."""
    if request.param == "chunked":
        spark.conf.set(scan.CHUNK_ROWS_CONF, "7")
    yield request.param
    spark.conf.unset(scan.CHUNK_ROWS_CONF)

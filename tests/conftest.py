import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardlog.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data(spark):
    from wardlog.sources.views import Data

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return Data(spark, DATA)


@pytest.fixture
def rows(spark):
    """Builds a frame from tuples and a DDL schema."""
    return lambda values, schema: spark.createDataFrame(values, schema)

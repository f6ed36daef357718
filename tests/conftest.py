import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parley.session import build_session  # noqa: E402
from parley.sources.bridge import Bridge  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("parley-tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Bridge(spark, DATA)


@pytest.fixture
def as_of():
    return datetime(2024, 1, 31)

"""One local session for all tests."""

import pytest
from latticework.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests", "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsweft.operators.classify import Classifier  # noqa: E402
from newsweft.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "newsweft-tests", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def classifier():
    return Classifier()


@pytest.fixture(scope="session")
def now():
    return dt.datetime(2026, 9, 18, 12, 0, 0)

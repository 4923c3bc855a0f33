import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelloom import build_session  # noqa: E402
from labelloom.sources import caches  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4, **{"spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    caches.BUCKETS = 4  # the tables are small
    yield session
    session.stop()

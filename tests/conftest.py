from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session

    session = get_session("local[4]", shuffle_partitions=4, app="tidemark-tests")
    yield session
    session.stop()

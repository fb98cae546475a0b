import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from boxloom.session import build

    session = build("tests", partitions=4)
    yield session
    session.stop()

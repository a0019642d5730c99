import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pagescale.session import local_session

    session = local_session("tests", cores="8", partitions=4, memory="8g")
    yield session
    session.stop()

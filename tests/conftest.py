import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIX = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skillweave.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, memory="8g", app="skillweave-tests")
    yield s
    s.stop()


@pytest.fixture
def fix():
    return lambda name: os.path.join(FIX, name)

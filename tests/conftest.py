"""One local session for all tests; its shuffles are small, its scratch tables go to a temporary folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ravelin.session import build_session

    session = build_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables are not here")
    return SMALL

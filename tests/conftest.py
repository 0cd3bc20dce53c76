import signal
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]


LIMIT = 300  # seconds for one test


@pytest.fixture(autouse=True)
def time_limit():
    """A test that takes too long fails instead of holding up all others."""

    def stop(*_):
        raise TimeoutError(f"the test took more than {LIMIT} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    from loreforge.session import session

    s = session("8", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"

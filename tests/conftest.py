import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  registers the package for task functions

    s = harness.session(4)
    yield s
    s.stop()

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trailmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")

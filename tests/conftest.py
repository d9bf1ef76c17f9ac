import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from ownerscope.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "labelwise-tests")


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("LABELWISE_TEST_SF", "/root/testdata/sf0.001")

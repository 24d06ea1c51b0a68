from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from steadfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", "steadfold-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"

"""One small session for all tests; the workers find the package through PYTHONPATH."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import build_session

    s = build_session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

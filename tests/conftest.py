import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from wardlight.operators import ordered  # noqa: E402
from wardlight.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture
def tiny_ranges(monkeypatch):
    """Force the ordered operators to cut even a handful of rows into several ranges."""
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(ordered, "QUANTILE_RANGE", 3)

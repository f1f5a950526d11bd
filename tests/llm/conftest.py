import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

from wardlight.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4")


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from ``(doc_id, text)`` pairs."""

    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build

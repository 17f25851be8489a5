import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from slotwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="8", shuffle_partitions=8, app="slotwise-tests")


@pytest.fixture()
def make(spark):
    """Frame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)

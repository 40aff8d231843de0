import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture
def hot(spark):
    """Groups are cut into several slices on small data."""
    # AQE would merge the tiny slices of a test into one
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

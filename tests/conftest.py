from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ridgeflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """Makes ordered scans split keys above a tiny size for the length of a test."""
    spark.conf.set("spark.ridgeflow.chunkRows", "7")
    yield
    spark.conf.unset("spark.ridgeflow.chunkRows")

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fleetlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """Build line rows of one file from a list of texts, ``block`` rows to a block."""

    def build(texts, file_path="f", block=3):
        rows = [(file_path, i // block, i, len(t.encode()) + 1, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "file_path string, block_start bigint, seq bigint, n_bytes bigint, value string"
        )

    return build

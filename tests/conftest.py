import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from crewlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, spark__sql__shuffle__partitions="4")


@pytest.fixture()
def one(spark):
    """Evaluate expressions on a one-row frame and return the row."""
    def run(**cols):
        return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return run

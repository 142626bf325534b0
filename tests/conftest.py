import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from nameloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples; nulls first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in t])

import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from fogbank import session

    return session.build("tests", 2, 3)


@pytest.fixture
def at():
    """A UTC time in January 2025: day, hour, minute."""
    return lambda day, hour=0, minute=0: datetime(2025, 1, day, hour, minute, tzinfo=UTC)


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]

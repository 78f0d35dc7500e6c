import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lapwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "lapwise-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LAPWISE_TEST_SF", "/root/testdata/sf0.001")


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rondo.session import build_session, clear_shared  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests")
    yield session
    clear_shared(session)


@pytest.fixture(scope="session")
def tables(spark):
    from rondo.plans.adapters import Tables

    return Tables(spark, "/root/testdata/sf0.001")

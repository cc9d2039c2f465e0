from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tieout.session import local_session, ship_package

    session = local_session(cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session

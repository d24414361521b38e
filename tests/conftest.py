import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from heliospark.session import local_session, ship_package

    session = local_session("*", 8)
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    return session

"""One small session for all tests."""

import pytest

from ledgerloom.session import local_session
from ledgerloom.shipping import ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()

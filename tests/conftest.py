import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tidewatch-tests", cores=8, shuffle_partitions=4)
    yield session
    session.stop()

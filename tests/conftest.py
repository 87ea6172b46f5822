import pytest

from isotherm.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="isotherm-tests")
    yield session
    session.stop()

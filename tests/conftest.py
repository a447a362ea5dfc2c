import pytest

from siltstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

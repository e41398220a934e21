import pytest

from weft.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, partitions=4, spark__driver__memory="4g")

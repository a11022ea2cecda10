import pytest

from folioworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF

import pytest

from webloom.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, spark__sql__shuffle__partitions="4")

import pytest

from heddle.session import attach, local_session


@pytest.fixture(scope="session")
def spark():
    s = attach(local_session("tests", 4, 8))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

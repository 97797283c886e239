import datetime as dt

import pytest

from cellgrid.session import local_session

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "cellgrid-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(hour: float, day: int = 1, month: int = 1, year: int = 2024) -> dt.datetime:
    return dt.datetime(year, month, day) + dt.timedelta(hours=hour)

import tempfile

import pytest

from tidegauge.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="tidegauge-tests-"), spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tidegauge-wh-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()

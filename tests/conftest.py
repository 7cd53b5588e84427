import os

import pytest

from tracelark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "tests",
        os.environ.get("TEST_MASTER", "local[4]"),
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="3g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path

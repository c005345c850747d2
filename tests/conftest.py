import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparrix.runtime import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session("4", 2, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g", "spark.default.parallelism": "2", "spark.sql.adaptive.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path

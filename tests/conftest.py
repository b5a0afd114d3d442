import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.check import oracle_connection  # noqa: E402
from tracemill.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return oracle_connection(SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import build_session

    session = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
